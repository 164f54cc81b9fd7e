"""Languages of documents and of the stretches of mixed-language texts (problem 2).

The scripts of a sentence narrow the candidates. Where several languages share a script, every word (in Han and kana every
character) has a score in each trained one; Viterbi over the words with a switching penalty, which is infinite inside a sentence,
labels the text: stretches are therefore runs of whole sentences, and foreign words inside a sentence do not count. Words
that hold digits or are joined to them (identifiers, hexadecimal numbers) are no words of a language; a sentence without words
says nothing and goes with its neighbours.

Word scores are fitted on a bounded sample of labelled documents (``sample_rows``, by hash of the id). Stored labels may be
wrong, so the sample's sentences are labelled anew by the model and fitted again; a label whose sentences mostly go to other
languages is not a language of the corpus and is dropped. A stretch few of whose words the chosen language is known to
have is in a language that the sample does not have; the odds of that follow from how many words of a document other documents of
its language have, too.

The confidence of a stretch is the probability of its language against the second best and against an unknown language, the
evidence of words damped (``DAMPING``), for words of one text do not come independently.

Defined results: null, empty and blank texts give no record; a text without letters gets ``zxx`` (no linguistic content), confidence 0, and
is no case; a text in a language or script that is not known gets ``und`` and is a case; labels are compared as
ISO 639-1 codes, whatever their spelling or region; repeated rows of an id count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import providers
from ..runtime import table
from .letters import TO_LATIN
from .sentences import sentence_spans

# ISO 639-1 code, ISO 639-2 codes, names.
LANGUAGES = """
en eng english englisch inglés anglais|de deu ger german deutsch|fr fra fre french français|es spa spanish español castellano
pt por portuguese português|it ita italian italiano|nl nld dut dutch nederlands|ru rus russian русский|uk ukr ukrainian українська
zh zho chi cmn chinese 中文 mandarin|ja jpn japanese 日本語|ko kor korean 한국어|th tha thai ไทย|lo lao|hi hin hindi हिन्दी|ne nep nepali
ar ara arb arabic العربية|fa fas per farsi persian|ur urd urdu|he heb hebrew|el ell gre greek|pl pol polish|cs ces cze czech|sv swe swedish
da dan danish|no nor nb nn norwegian|fi fin finnish|tr tur turkish|vi vie vietnamese|id ind indonesian|ro ron rum romanian|hu hun hungarian
"""
_CODE = {name: row.split()[0] for row in LANGUAGES.replace("\n", "|").split("|") if row.strip() for name in row.split()}

#: Scripts and the languages written in them, the commonest first. Of those only trained ones compete; a script without a trained one falls to its first.
SCRIPTS = {
    "Latin": "en de fr es pt it nl pl cs sv da no fi tr vi id ro hu",
    "Cyrillic": "ru uk",
    "Han": "zh ja",
    "Kana": "ja",
    "Hangul": "ko",
    "Thai": "th",
    "Lao": "lo",
    "Devanagari": "hi ne mr",
    "Arabic": "ar fa ur",
    "Hebrew": "he",
    "Greek": "el",
    "Armenian": "hy",
    "Georgian": "ka",
    "Ethiopic": "am ti",
    "Bengali": "bn as",
    "Gurmukhi": "pa",
    "Gujarati": "gu",
    "Oriya": "or",
    "Tamil": "ta",
    "Telugu": "te",
    "Kannada": "kn",
    "Malayalam": "ml",
    "Sinhala": "si",
    "Khmer": "km",
    "Myanmar": "my",
    "Tibetan": "bo dz",
    "Mongolian": "mn",
    "Thaana": "dv",
}
#: Letters of every other script.
OTHER = "Other"
_NAMES = [*SCRIPTS, OTHER]
_BY_SCRIPT = {s: v.split() for s, v in SCRIPTS.items()} | {OTHER: []}
#: What a text is in if it has letters of no known language, and if it has none at all.
UNKNOWN, NO_LANGUAGE = "und", "zxx"

_WEAK = 64


def _class_table() -> np.ndarray:
    """Script number + 1 by code point; letters that look like those of another script have 64 added; 0: no letter."""
    t = np.zeros(0x30000, np.uint8)
    all_ = "".join(c for c in map(chr, range(0x30000)) if not "\ud800" <= c <= "\udfff")
    for c in regex.findall(r"\p{L}", all_):
        t[ord(c)] = len(_NAMES)
    for i, s in enumerate(SCRIPTS):
        p = r"[\p{Hiragana}\p{Katakana}ー]" if s == "Kana" else rf"[\p{{{s}}}&&[\p{{L}}\p{{M}}\p{{So}}]]"
        for c in regex.findall(p, all_, flags=regex.V1):
            t[ord(c)] = i + 1
    t[[*TO_LATIN, *{ord(c) for c in TO_LATIN.values()}]] += _WEAK
    return t


_TABLE = _class_table()
_FOREIGN_FORM = regex.compile(r"[\p{Cf}\p{M}ﬀ-ﭏ＀-￯]")
_FORMS = np.zeros(0x30000, np.bool_)
_FORMS[[ord(c) for c in regex.findall(_FOREIGN_FORM.pattern, "".join(c for c in map(chr, range(0x30000)) if not "\ud800" <= c <= "\udfff"))]] = True
_WORD = re.compile(r"\b(?<!\d-)[^\W\d_]+\b(?!-\d)")
_WITH_DIGITS = re.compile(r"[0-9][0-9A-Za-z_]*")
_DENSE_CHARS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_UNIT = 64  # score units in a natural log
_MOST = 6 * _UNIT  # a word's most
#: Words are summed in packed fields, so many at a time that no sum reaches the next field; the sums of a longer sentence are added one by one.
_AT_ONCE, _FIELD, _MASK, _KNOWN = 128, 16, (1 << 16) - 1, 8
assert _AT_ONCE * _MOST <= _MASK and _AT_ONCE < 1 << _KNOWN
_BACKGROUND = 20.0  # words of the whole sample that every language's counts are smoothed by
_FAR = math.inf  # a language that the script excludes
#: The evidence of words counts this much in a confidence.
DAMPING = 0.5
#: Share of a text's words that an unknown language of the same script has in common with a trained one, and the odds against an unknown one.
SHARED_WORDS, KNOWN_ODDS = 0.1, 99.0


def iso_code(label: str | None) -> str | None:
    """ISO 639-1 code of a label in any spelling or regional form; None if it names no language."""
    if not label:
        return None
    key = label.strip().lower().replace("_", "-")
    return _CODE.get(key) or _CODE.get(key.split("-")[0])


def sentence_scripts(text: str, starts: list[int], ends: list[int]) -> tuple[list[str | None], bool]:
    """The deciding script of each sentence (letters of words with digits do not count), and whether the text holds neither
    presentation forms nor letters that look like Latin ones."""
    if text.isascii():
        return ["Latin"] * len(starts), True
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
    present = np.bincount(cls, minlength=128)
    others = int(present[_WEAK + 2 :].sum())
    plain = not others and not _FORMS[np.minimum(codes, len(_FORMS) - 1)].any()
    if not others and present[1] + present[1 + _WEAK] == present[1:].sum():  # a text all in Latin letters: a sentence without words has no language anyway
        return ["Latin"] * len(starts), plain
    for m in _WITH_DIGITS.finditer(text):
        a = m.start()
        while a and (text[a - 1].isascii() and text[a - 1].isalpha() or text[a - 1] in "-_"):  # the letters before the digits
            a -= 1
        if m.end() - a > 1:
            cls[a : m.end()] = 0
    n = len(starts)
    which = np.repeat(np.arange(n), np.array(ends) - np.array(starts))
    pick = np.concatenate([cls[a:e] for a, e in zip(starts, ends)]) if n > 1 or starts[0] or ends[0] < len(cls) else cls
    counts = np.bincount(which * 128 + pick, minlength=128 * n).reshape(n, 128)
    strong, weak = counts[:, 1:_WEAK].astype(np.float64), counts[:, _WEAK + 1 :]
    out: list[str | None] = []
    han, kana = (_NAMES.index(x) for x in ("Han", "Kana"))
    strong[:, han] *= 2.5
    strong[:, kana] *= 2.5
    dense = strong[:, han] + strong[:, kana]
    for i in range(n):
        s = strong[i]
        best = int(s.argmax())
        if dense[i] and dense[i] >= s[best]:
            out.append("Kana" if s[kana] else "Han")
        elif s[best]:
            out.append(_NAMES[best])
        else:
            w = weak[i]
            best = int(w.argmax())
            out.append(_NAMES[best] if w[best] else None)
    return out, plain


class Evidence(NamedTuple):
    """What a sentence says: the penalty of each candidate language (the least is the best), its words, how many each candidate is known to have."""

    penalty: dict[str, float]
    words: int
    known: dict[str, int]


class WordScores:
    """Penalties of words by language and whether it has them, packed into one integer each so that a sentence is one sum."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: dict[str, int], typical: dict[str, float] | None = None):
        self.langs = langs
        self.index = {x: i for i, x in enumerate(langs)}
        self.by_script = {s: [x for x in v if x in self.index] for s, v in _BY_SCRIPT.items()}
        self.words = _Lookup(words)
        self.words.grams, self.words.n = grams, len(langs)
        self.typical = typical or {}

    def sentence(self, s: str, script: str, plain: bool = False) -> Evidence | None:
        """What sentence s says; ``plain``: it holds neither presentation forms nor letters that look like Latin ones."""
        cand = self.by_script[script]
        if not cand or len(_BY_SCRIPT[script]) == 1:
            return Evidence({(cand or _BY_SCRIPT[script] or [UNKNOWN])[0]: 0}, 0, {})
        if not plain and not s.isascii() and (script in ("Latin", "Cyrillic")):
            if _FOREIGN_FORM.search(s):
                s = unicodedata.normalize("NFKC", regex.sub(r"\p{Cf}+", "", s))
            if script == "Latin":
                s = s.translate(TO_LATIN)
        found = _DENSE_CHARS.findall(s) if script in ("Han", "Kana") else _WORD.findall(s.lower())
        if not found:
            return None
        n, at = len(found), [self.index[x] for x in cand]
        up = _FIELD * len(self.langs)
        pen, known = [0] * len(cand), [0] * len(cand)
        for k in range(0, n, _AT_ONCE):
            total = sum(map(self.words.__getitem__, found if n <= _AT_ONCE else found[k : k + _AT_ONCE]))
            for j, i in enumerate(at):
                pen[j] += (total >> (_FIELD * i)) & _MASK
                known[j] += (total >> (up + _KNOWN * i)) & 255
        return Evidence(dict(zip(cand, pen)) if len(cand) > 1 else {cand[0]: 0}, n, dict(zip(cand, known)))

    def known_odds(self, lang: str, words: int, known: int) -> float:
        """Log odds of a trained language against an unknown one, from the words that it is known to have; infinite where that says nothing."""
        t = min(0.6, self.typical.get(lang, 0.0))
        if not words or t <= 1.5 * SHARED_WORDS:
            return math.inf
        return DAMPING * (known * math.log(t / SHARED_WORDS) + (words - known) * math.log((1 - t) / (1 - SHARED_WORDS))) + math.log(KNOWN_ODDS)


class _Lookup(dict):
    grams: dict[str, int]
    n: int

    def __missing__(self, w: str) -> int:
        """An unknown word: the mean of its character trigrams, which counts less than a known word."""
        sums = [0] * self.n
        g = [self.grams[x] for x in _trigrams(w) if x in self.grams]
        for v in g:
            for i in range(self.n):
                sums[i] += (v >> (_FIELD * i)) & _MASK
        v = sum((x // (2 * max(1, len(g)))) << (_FIELD * i) for i, x in enumerate(sums))
        if len(self) < 400_000:
            self[w] = v
        return v


def _trigrams(w: str) -> list[str]:
    w = f"^{w}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _penalties(counts: dict[str, Counter], langs: list[str], least: int, known: int = 0) -> dict[str, int]:
    """Packed penalties from counts by language: log likelihood below the best language's, limited. With ``known``, a further field for
    each language says whether it has the word at least so often."""
    total = {x: sum(counts[x].values()) + 1.0 for x in langs}
    both = Counter()
    for x in langs:
        both.update(counts[x])
    everything = max(1, sum(both.values()))
    out = {}
    for w, k in both.items():
        if k < least:
            continue
        logs = [math.log((counts[x][w] + 1e-3 + _BACKGROUND * k / everything) / (total[x] + _BACKGROUND)) for x in langs]
        top = max(logs)
        out[w] = sum(min(_MOST, round((top - v) * _UNIT)) << (_FIELD * i) for i, v in enumerate(logs))
        if known:
            out[w] += sum(1 << (_FIELD * len(langs) + _KNOWN * i) for i, x in enumerate(langs) if counts[x][w] >= known)
    return out


def _tokens(s: str, script: str) -> list[str]:
    if script in ("Han", "Kana"):
        return _DENSE_CHARS.findall(s)
    if not s.isascii() and _FOREIGN_FORM.search(s):
        s = unicodedata.normalize("NFKC", regex.sub(r"\p{Cf}+", "", s))
    return _WORD.findall(s.lower())


def _own_languages(sents: list, langs: list[str], most: float = 0.6) -> list[str]:
    """The labels that are languages of the sample: not those most of whose words are commoner under another label."""
    counts: dict[str, Counter] = defaultdict(Counter)
    by_label: dict[str, list] = defaultdict(list)
    for lab, sc, toks, _ in sents:
        if lab in _BY_SCRIPT[sc]:
            counts[lab].update(toks)
            by_label[lab].append(toks)
    kept = [x for x in langs if counts[x]]
    for x in sorted(kept, key=lambda x: (sum(counts[x].values()), x)):
        others = [y for y in kept if y != x and any(x in v and y in v for v in _BY_SCRIPT.values())]
        if not others:
            continue
        covered = [max(sum(counts[y][w] >= 2 * counts[x][w] for w in toks) / len(toks) for y in others) for toks in by_label[x] if toks]
        if covered and sum(covered) / len(covered) > most:
            kept.remove(x)
    return kept


def fit_word_scores(labelled: list[tuple[str, str]], rounds: int = 2, least_rows: int = 3) -> WordScores:
    """labelled: (ISO code, text) of a bounded sample."""
    rows = Counter(x for x, _ in labelled)
    langs = sorted(x for x in rows if rows[x] >= least_rows)
    sents = []
    for doc, (lab, text) in enumerate(labelled):
        a, e = sentence_spans(text)
        if lab in langs and a:
            sents += [(lab, sc, _tokens(text[p:q], sc), text[p:q], doc) for p, q, sc in zip(a, e, sentence_scripts(text, a, e)[0]) if sc]
    langs = _own_languages([x[:4] for x in sents], langs)
    labels = [x[0] if x[0] in langs else "" for x in sents]
    model = WordScores(langs, {}, {})
    for r in range(rounds + 1):
        counts: dict[str, Counter] = defaultdict(Counter)
        grams: dict[str, Counter] = defaultdict(Counter)
        for lab, (_, sc, toks, *_s) in zip(labels, sents):
            if lab in _BY_SCRIPT[sc]:
                counts[lab].update(toks)
        langs = [x for x in langs if counts[x]]
        for x in langs:
            for w, k in counts[x].items():
                for g in _trigrams(w):
                    grams[x][g] += k
        model = WordScores(langs, _penalties(counts, langs, 2, 2), _penalties(grams, langs, 3))
        if r == rounds:
            break
        new = []
        for lab, sc, _toks, s, _doc in sents:
            found = model.sentence(s, sc)
            pen = dict(found.penalty) if found else {"": 0}
            if lab in pen:  # the stored label weighs a little
                pen[lab] -= _UNIT
            new.append(min(pen, key=lambda x: (pen[x], x)))
        labels = new
    model.typical = _typical(sents, labels)
    return model


def _typical(sents: list, labels: list[str]) -> dict[str, float]:
    """By language, the share of the words of a document that another document of the language has, too."""
    docs: dict[str, dict[str, int]] = defaultdict(dict)  # word -> the one document that has it, -1: several have it
    for lab, (_, sc, toks, _s, doc) in zip(labels, sents):
        if lab in _BY_SCRIPT[sc]:
            d = docs[lab]
            for w in toks:
                d[w] = doc if d.get(w, doc) == doc else -1
    seen, hit = Counter(), Counter()
    for lab, (_, sc, toks, _s, _doc) in zip(labels, sents):
        if lab in _BY_SCRIPT[sc]:
            seen[lab] += len(toks)
            hit[lab] += sum(docs[lab][w] < 0 for w in toks)
    return {x: hit[x] / seen[x] for x in seen if seen[x]}


def segments(text: str, model: WordScores, switch: float = 7.0) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the longest runs of whole sentences in one language."""
    starts, ends = sentence_spans(text)
    if not starts:
        return []
    scripts, plain = sentence_scripts(text, starts, ends)
    emit = [model.sentence(text[a:e], sc, plain) if sc else None for a, e, sc in zip(starts, ends, scripts)]
    langs = sorted({x for m in emit if m for x in m.penalty})
    if not langs:
        return [(starts[0], ends[-1], NO_LANGUAGE, 0.0)]
    best: set[str] = set(langs)
    for m in emit:
        if m:
            low = min(m.penalty.values())
            best &= {x for x, v in m.penalty.items() if v == low}
    # a language that is best in every sentence is best in all, with no change to pay for
    path = [min(best)] * len(emit) if best else _viterbi(emit, langs, round(switch * _UNIT))
    runs: list[list] = []  # start, end, language, penalties of the languages that all its sentences may be in, words, known words
    for i, x in enumerate(path):
        if not runs or runs[-1][2] != x:
            runs.append([starts[i], ends[i], x, None, 0, 0])
        r = runs[-1]
        r[1] = ends[i]
        if (m := emit[i]) is not None:
            r[3] = m.penalty if r[3] is None else {k: v + r[3][k] for k, v in m.penalty.items() if k in r[3]}
            r[4] += m.words
            r[5] += m.known.get(x, 0)
    out: list[list] = []
    for a, e, x, pen, words, known in runs:
        odds = model.known_odds(x, words, known)
        untrained = x not in model.index and len(rivals := _rivals(x)) > 1  # the script's first language stands for all
        others = [DAMPING * (v - pen[x]) / _UNIT for k, v in (pen or {}).items() if k != x]
        p = 1 / (1 + sum(math.exp(-max(-700.0, g)) for g in (*others, odds)))
        if odds < 0:
            x, p = UNKNOWN, 1 - 1 / (1 + math.exp(-max(-700.0, odds)))
        elif untrained:
            p = 1 / len(rivals)
        elif x == UNKNOWN:
            p = 0.0
        if out and out[-1][2] == x:
            n, k = out[-1][1] - out[-1][0], e - a
            out[-1][3] = (out[-1][3] * n + p * k) / max(1, n + k)
            out[-1][1] = e
        else:
            out.append([a, e, x, p])
    return [tuple(x) for x in out]


def _rivals(lang: str) -> list[str]:
    return next((v for v in _BY_SCRIPT.values() if lang in v), [lang])


def _viterbi(emit: list[Evidence | None], langs: list[str], pen: int) -> list[str]:
    """The cheapest language of each sentence, with a penalty for each change."""
    cost: dict[str, float] = {x: 0 for x in langs}
    back: list[dict[str, str] | None] = []
    for m in emit:
        if m is None:
            back.append(None)
            continue
        low = min(cost, key=lambda x: (cost[x], x))
        through = cost[low] + pen
        nxt, frm = {}, {}
        for x in langs:
            c = cost[x]
            frm[x] = x
            if through < c:
                c, frm[x] = through, low
            nxt[x] = c + m.penalty.get(x, _FAR)
        base = min(nxt.values())
        cost = {x: c - base for x, c in nxt.items()}
        back.append(frm)
    path: list[str] = [""] * len(emit)
    cur = min(cost, key=lambda x: (cost[x], x))
    for i in range(len(emit) - 1, -1, -1):
        path[i] = cur
        if (b := back[i]) is not None:
            cur = b[cur]
    return path


def training_sample(documents: DataFrame, rows: int) -> list[tuple[str, str]]:
    """About ``rows`` labelled documents and never more than 1.25 times as many, with the ISO code of their label.

    Those of the least id hashes are taken by a threshold that follows from the number of labelled documents, so a task sends its
    share of the sample and not a sample of its own.
    """
    named = documents.filter(F.length("lang") > 0)
    n = named.select("lang").count()
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 24)  # 40 bits
    share = min(1.0, 1.1 * rows / max(1, n))
    d = named.filter(h < F.lit(math.ceil(share * (1 << 40)))).filter(F.length("text") > 0).select("lang", "text", h.alias("h"), "doc_id")
    got = d.limit(math.ceil(1.25 * rows)).select("lang", "text", "h", "doc_id").collect()
    got.sort(key=lambda r: (r["h"], r["doc_id"]))
    return [(iso_code(r["lang"]), r["text"]) for r in got if iso_code(r["lang"])]


def fit_languages(documents: DataFrame, sample_rows: int = 2000) -> WordScores:
    return fit_word_scores(training_sample(documents, sample_rows))


def language_segments(df: DataFrame, model: WordScores, id_col: str, text_col: str, label: str) -> DataFrame:
    """(rec_id, stored, lang, confidence, segments) of each record with text: its main language (by letters), the confidence of
    it, and its stretches. ``label`` is an expression for the stored label; its ISO code is given back. Narrow: no shuffle."""
    seg = "array<struct<start:int,end:int,lang:string,confidence:double>>"
    schema = f"rec_id string, stored string, lang string, confidence double, segments {seg}"
    sent = df.sparkSession.sparkContext.broadcast((model.langs, dict(model.words), model.words.grams, model.typical))  # bounded by the sample

    def label_batches(batches):
        scores = WordScores(*sent.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, t, lab in zip(*(c.to_pylist() for c in b.columns)):
                segs = segments(t, scores) if t else []
                if not segs:
                    continue
                size: Counter = Counter()
                for a, e, x, _ in segs:
                    size[x] += e - a
                main = min(size, key=lambda x: (-size[x], x))
                conf = sum((e - a) * c for a, e, x, c in segs if x == main) / sum(size.values())
                for c, v in zip(cols, (i, iso_code(lab), main, conf, [dict(zip(("start", "end", "lang", "confidence"), s)) for s in segs])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], kind)], names=["rec_id", "stored", "lang", "confidence", "segments"])

    return df.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"), F.expr(label)).mapInArrow(label_batches, schema)


def language_cases(records: DataFrame) -> DataFrame:
    """(rec_id, seg_start, lang) of the stretches of records with several languages or a label that is not theirs."""
    case = (F.size(F.array_distinct("segments.lang")) > 1) | ~F.col("stored").eqNullSafe(F.col("lang"))
    bad = records.filter((F.col("lang") != NO_LANGUAGE) & case)
    once = bad.groupBy("rec_id").agg(F.min("segments").alias("segments"))
    return once.select("rec_id", F.explode("segments").alias("s")).select("rec_id", F.col("s.start").alias("seg_start"), F.col("s.lang").alias("lang"))


def register(model: WordScores, name: str = "trained") -> None:
    """Makes the model a language provider of the core: the main language of each text, ``und`` where it is not known."""
    providers.register("language", name, lambda texts: [main_language(t, model) for t in texts])


def main_language(text: str, model: WordScores) -> str:
    size: Counter = Counter()
    for a, e, x, _ in segments(text, model):
        size[x] += e - a
    return min(size, key=lambda x: (-size[x], x)) if size else UNKNOWN


def _records(spark, d):
    docs, chunks = table(spark, d, "documents"), table(spark, d, "chunks")
    model = fit_languages(docs)
    return language_segments(docs, model, "doc_id", "text", "lang"), language_segments(chunks, model, "id", "content", "metadata.language")


def p2_found(spark, d):
    a, b = _records(spark, d)
    a, b = (language_cases(x.withColumn("rec_id", F.col("rec_id"))).withColumn("rec_kind", F.lit(k)) for x, k in ((a, "document"), (b, "chunk")))
    return a.unionByName(b).select("rec_kind", "rec_id", "seg_start", "lang")


def p2_languages(spark, d):
    """Main language, confidence and stretches of every document and chunk."""
    a, b = _records(spark, d)
    b = b.groupBy("rec_id").agg(*[F.min(F.struct("stored", "lang", "confidence", "segments")).alias("x")]).select("rec_id", "x.*")
    return a.withColumn("rec_kind", F.lit("document")).unionByName(b.withColumn("rec_kind", F.lit("chunk")))
