"""Sentence boundaries across languages and scripts (problem 1).

The rules follow the standard sentence-break properties: the terminators of all scripts (``STerm``), those that need
white space after them (``ATerm``), closing punctuation (``Close``), and no break before a lower-case continuation. On
top of them lie suppression lists of abbreviations by language (that of the paragraph, told by its alphabet and its commonest
words), quotation and bracket handling, list markers, and the spaces of scripts that write no terminators. An abbreviation that is
also an ordinary word ("no", "art") only suppresses a break before what it would refer to.

Defined results: null, empty and blank texts have no units; a unit never begins or ends with white space; the units of a text
cover all of it but white space; an extremely long text costs time in proportion to its length.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .letters import TO_LATIN

# Abbreviations by language, without their last full stop, in lower case.
#: Within a sentence: they never end one.
ABBREVIATIONS = {
    "en": "messrs hon gen rev capt lt sgt cf e.g i.e vs viz approx dept resp incl est",
    "de": "hr fr bzw ca vgl z.b d.h u.a o.ä i.d.r evtl ggf inkl zzgl hrsg sog z.t m.e z bspw st str",
    "fr": "m mm mme mlle me pr cf env p.ex c.-à-d av éd",
    "es": "sr sra srta dra ud uds cf aprox p.ej ej av ee.uu",
    "pt": "sr sra dra profa cf aprox p.ex ex av",
    "it": "sig dott cfr es p.es",
    "nl": "dhr mevr bijv d.w.z ca",
    "ru": "им ул см т.е т.к т.н напр проф акад гр д",
    "ar": "د م أ",
    "hi": "डॉ श्री प्रो पं सु",
}
#: Titles that stand before names in texts of any language of their script.
TITLES = "mr mrs ms dr prof pr st sr sra srta dra mme mlle dhr mevr sig dott"
#: Before a number or a letter that counts something, or in a citation; the same word may end a sentence elsewhere ("no", "art", "ex").
REFERENCES = {
    "en": "no nos fig figs sec secs ch vol pp p ref eq ex al art cap col",
    "de": "nr abb abs kap bd s art fig",
    "fr": "fig art p pp réf vol chap n",
    "es": "núm fig art pág págs cap ref vol n.º",
    "pt": "fig art pág págs cap ref vol n núm",
    "it": "fig art pag cap vol n",
    "nl": "nr blz afb fig art",
    "ru": "рис стр гл ст с п",
    "ar": "ص ج",
    "hi": "",
}
#: They end a sentence if what follows begins one.
ENDING_ABBREVIATIONS = "etc usw ltd inc corp co gmbh llc bros jr a.m p.m u.s u.k e.u usf т.д т.п г гг руб коп др в вв млн млрд тыс u.s.w u.a.m ltda cía s.a c.v"
#: Before a number with a full stop they make it an ordinal (in German).
ORDINAL_BEFORE = "der die das den dem des am vom zum zur im ab bis seit jeder jede jedes"
#: Words that are common in one language: they tell the language of a paragraph, and that a sentence begins after a single letter.
FUNCTION_WORDS = {
    "en": "the of and to is was were that it for with they he she we you this these those are not then there when if after before but so our their his her its an from by has had will",
    "de": "der die das und ist nicht mit den dem des von zu ein eine wurde auf dann es er sie wir ich wenn aber im am nach vor bei für dieser diese dieses auch als wird sind",
    "fr": "le la les des et est une du que dans pour il elle ils elles sont pas ce cette ces nous vous sur avec mais puis quand après qui au aux",
    "es": "el la los las del que y en un una por con se no es son para su al esta este pero cuando después fue como lo",
    "pt": "o os as do da dos das que e em um uma por com não se para ao foi na no mas quando depois este esta são pelo pela",
    "it": "il lo gli di che e un una per con non del della sono è si da dal nel nella ma quando dopo questo questa",
    "nl": "de het een en van is dat op te niet met voor zijn er dan maar als wij zij deze dit werd",
}

#: After a number with a full stop they make it one, too.
ORDINAL_AFTER = "januar februar märz april mai juni juli august september oktober november dezember quartal jahrhundert stock tag mal"
#: References that are also ordinary words: a text may well end with them.
ORDINARY_WORDS = "no art cap ref ex al col"

_FORMAT = regex.compile(r"\p{Cf}+")


_ALL = "".join(c for c in map(chr, range(0x20000)) if not "\ud800" <= c <= "\udfff")


def _members(prop: str) -> str:
    """All characters of a property, escaped for a character class."""
    return re.escape("".join(regex.findall(prop, _ALL)))


def _plain(token: str) -> str:
    """The token in ordinary characters and lower case."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", _FORMAT.sub("", token)).translate(TO_LATIN)
    return token.lower()


def _by_language(lists: dict[str, str]) -> dict[str | None, frozenset[str]]:
    """The lists by language; None: of all languages, for a text whose language does not show."""
    out: dict[str | None, frozenset[str]] = {x: frozenset(_plain(w) for w in v.split()) for x, v in lists.items()}
    return out | {None: frozenset().union(*out.values())}


_NEVER_ENDS = _by_language({x: f"{v} {TITLES if v.isascii() or x in FUNCTION_WORDS else ''}" for x, v in ABBREVIATIONS.items()})
_REFERENCE = _by_language(REFERENCES)
_MAY_END = frozenset(_plain(w) for w in ENDING_ABBREVIATIONS.split())
_LETTER_ONLY = frozenset(_plain(w) for w in ("г", "руб"))
#: Titles, and abbreviations with a full stop inside, mean the same in every language.
_EVERYWHERE = (frozenset(TITLES.split()) | frozenset(w for w in _NEVER_ENDS[None] if "." in w)) - _MAY_END
#: Every word that some list has: only where one of these stands does the language matter.
_LISTED = _NEVER_ENDS[None] | _REFERENCE[None]
#: Ends of abbreviations that are long enough for the fast path.
_FIVE = frozenset(w[-5:] for w in _LISTED | _MAY_END if len(w) >= 5)
_ORDINAL, _ORDINAL_NEXT = frozenset(ORDINAL_BEFORE.split()), frozenset(ORDINAL_AFTER.split())
_ORDINARY = frozenset(ORDINARY_WORDS.split())
_FUNCTION = {x: frozenset(v.split()) for x, v in FUNCTION_WORDS.items()}
_WEIGHT = {w: [x for x, v in _FUNCTION.items() if w in v] for v in _FUNCTION.values() for w in v}
_ALPHABETS = [("ru", regex.compile(r"\p{Cyrillic}")), ("ar", regex.compile(r"\p{Arabic}")), ("hi", regex.compile(r"\p{Devanagari}"))]
_LATIN_WORD = re.compile(r"[^\W\d_]+")
_COUNTED = regex.compile(r"[\s\p{Cf}]*(?:[(\[#§№]|\p{N}|\p{Ll}|\p{Lu}(?!\p{L})|[IVXLC]+(?!\p{L})|\p{Lu}[\p{Lu}\p{Cf}]*[-‐./]?\p{N})")
_NEXT_WORD = regex.compile(r"[\s\p{Cf}]*([\p{L}\p{M}][\p{L}\p{M}\p{Cf}]*)")


#: Characters on either side of an abbreviation that tell the language of its sentence, so that a text costs time in proportion to its length.
LANGUAGE_WINDOW = 400


class _Languages:
    """The language of sentences and paragraphs of a text, found only where an abbreviation needs it."""

    def __init__(self, text: str):
        self.text, self.known = text, {}
        self.last: tuple[int, int, str | None, bool] = (-1, 0, None, False)  # start of a sentence, where it was asked, answer, whether it was the sentence's own

    def of(self, start: int, at: int, paragraph: tuple[int, int], word: str) -> str | None:
        """The language whose lists hold for word at text[..at] in the sentence that began at start: that of its alphabet, else that of the
        commonest words of the sentence, else of the paragraph, else of the text."""
        for lang, letters in _ALPHABETS:
            if letters.search(word):
                return lang
        s, asked, lang, own = self.last
        if s == start and (own or at - asked < LANGUAGE_WINDOW // 2):
            return lang
        a, e = paragraph
        begin = max(start, at - LANGUAGE_WINDOW)
        stop = self.text.find(". ", at + 1, min(e, at + LANGUAGE_WINDOW))
        lang = _language_of(self.text[begin:at]) or _language_of(self.text[begin : stop if stop >= 0 else min(e, at + LANGUAGE_WINDOW)])
        own = lang is not None
        for span in () if own else ((a, e), (0, len(self.text))):
            if span not in self.known:
                self.known[span] = _language_of(self.text[span[0] : span[1]])
            lang = lang or self.known[span]
        self.last = (start, at, lang, own)
        return lang


def _language_of(text: str) -> str | None:
    score: dict[str, float] = {}
    for w in _LATIN_WORD.findall(_plain(text)):
        for x in (of := _WEIGHT.get(w, ())):
            score[x] = score.get(x, 0.0) + 1 / len(of)
    best = sorted(score, key=lambda x: -score[x])[:2]
    return best[0] if best and (len(best) == 1 or score[best[0]] > score[best[1]]) else None


#: Scripts written without spaces between words whose space ends a unit.
_SPACED_UNITS = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: Scripts whose terminators need no white space after them.
_DENSE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Hangul}"

_W = r"[^\S\n]"
_MARK = r"(?:[-•*–—‣◦·▪●+]|\d{1,3}[.)]|\(?[^\W\d_]\)|\(\w{1,4}\)|[ivx]{1,4}[.)])"
_PARAGRAPH = re.compile(rf"\n{_W}*(?:\n\s*|(?={_MARK}{_W}))")
_MARKER = re.compile(rf"\s*{_MARK}{_W}+")
_TERMINATORS = _members(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]")
_OPENING, _CLOSING, _BOTH = "„«‹「『〈《【〔（([{", "»›」』〉》】〕）)]}”", "“\""
_KIND = {c: "open" for c in _OPENING} | {c: "close" for c in _CLOSING} | {c: "both" for c in _BOTH}
_EVENTS = np.zeros(0x20000, np.bool_)
_EVENTS[[ord(c) for c in "".join(regex.findall(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]", _ALL)) + _OPENING + _CLOSING + _BOTH]] = True
_EVENTS_AND_SPACES = _EVENTS.copy()
_EVENTS_AND_SPACES[[ord(c) for c in regex.findall(r"[^\S\n]", _ALL)]] = True
_TERM_RUN = re.compile(rf"[{_TERMINATORS}]+")
_HAS_GAPS = regex.compile(rf"[{_SPACED_UNITS}]{_W}")
_CLOSERS = regex.compile(r"[\p{Cf}\p{Pe}\p{Pf}\"'”’»]*")
_SPACES = regex.compile(r"[\s\p{Cf}]*")
_WHITE = regex.compile(r"\s*")
_DENSE_CHAR = regex.compile(rf"[{_DENSE}]")
_SPACED_CHAR = regex.compile(rf"[{_SPACED_UNITS}]")
_LATIN_DIGIT = regex.compile(r"[\p{Latin}\p{N}]")
_PAIR = {"„": "“”", "“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "〈": "〉", "《": "》", "【": "】", "〔": "〕", "（": "）)", "(": ")）", "[": "]", "{": "}", '"': '"', "»": "«"}
_BEFORE = regex.compile(r"[^\s(\[{“”\"„«»'‘]*$")
_SHORT_PART = regex.compile(r"(?<![\p{L}\p{N}])(\p{L}{1,2})\.[\s\p{Cf}]+$")
_WORD_BEFORE = regex.compile(r"([\p{L}\p{M}][\p{L}\p{M}\p{Cf}]*)[\s\p{Cf}]+$")


def _full_stop(text: str, start: int, a: int, e: int, nxt: str, closed: bool, langs: _Languages | None = None, paragraph: tuple[int, int] | None = None) -> bool:
    """Whether the full stop at text[a:e] ends the sentence that began at start; nxt is the next visible character, none at the end of a text."""
    token = _BEFORE.search(text, max(start, a - LONGEST_TOKEN), a).group()
    raw = _FORMAT.sub("", token) if not token.isascii() else token
    word = _plain(token)
    if not closed:
        before = a - len(token)
        joined = word
        if "." not in word and len(word) <= 3:  # "p. ej", "т. д", "u. a": the part before belongs to it
            m = _SHORT_PART.search(text, max(start, before - 8), before)
            if m and (len(word) <= 2 or f"{_plain(m.group(1))}.{word}" in _LISTED):
                joined = f"{_plain(m.group(1))}.{word}"
        if joined in _EVERYWHERE or word in _EVERYWHERE:
            return False
        begins = nxt.isupper() or nxt.isdigit() or not (nxt.islower() or nxt.isalpha())
        lang = None
        if (joined in _REFERENCE[None] or word in _REFERENCE[None]) and nxt.isdigit() and word not in _MAY_END and joined not in _MAY_END:
            return False  # a number of something, in whatever language
        initial = len(raw) == 1 and raw.isalpha() and (raw.isupper() or not raw.islower())
        follows = _NEXT_WORD.match(text, e) if initial or word.isdigit() else None
        if joined in _LISTED or word in _LISTED or (initial and follows and _plain(follows.group(1)) in _WEIGHT):
            lang = (langs or _Languages(text)).of(start, a, paragraph or (0, len(text)), word)
        if joined in _MAY_END or (joined not in _NEVER_ENDS[lang] and word in _MAY_END):
            return begins and not nxt.isdigit() if word in _LETTER_ONLY else begins or (nxt.isalpha() and not nxt.islower())
        if joined in _NEVER_ENDS[lang] or word in _NEVER_ENDS[lang]:
            return False
        if (joined in _REFERENCE[lang] or word in _REFERENCE[lang]) and (_COUNTED.match(text, e) or (nxt.isalpha() and not nxt.isupper()) or (not nxt and word not in _ORDINARY)):
            return False
        if initial:  # of a name, unless a sentence clearly begins
            after = _plain(follows.group(1)) if follows else ""
            return bool(_DENSE_CHAR.match(raw)) or (len(after) > 1 and after in (_FUNCTION.get(lang, ()) if lang else _WEIGHT))
        if word.isdigit() and len(word) <= 3:
            m = _WORD_BEFORE.search(text, max(start, before - LONGEST_TOKEN), before)
            if m and _plain(m.group(1)) in _ORDINAL or follows and _plain(follows.group(1)) in _ORDINAL_NEXT:
                return False
        if not word:
            return not nxt.islower()
    if nxt.islower():  # a continuation, unless a word ended and a name in lower case begins
        return not closed and raw.isalpha() and len(raw) > 1 and bool(_NAME_LIKE.match(text, e))
    return True


#: No abbreviation of the lists is longer.
LONGEST_TOKEN = 40
#: A name that is written in lower case: with a version number, or with a capital letter inside.
_NAME_LIKE = regex.compile(r"[\s\p{Cf}]+(?:\p{Ll}+[\s\p{Cf}]+[vｖ]?\d+[.\d]*|\p{Ll}+\p{Lu})")


#: closing character -> the characters that it closes
_CLOSES: dict[str, str] = {}
for _o, _c in _PAIR.items():
    for _x in _c:
        if not (_x == _o == "“"):
            _CLOSES[_x] = _CLOSES.get(_x, "") + _o


class _Open:
    """Opened quotations and brackets, innermost last, with where each kind stands: any depth in constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.where: dict[str, list[int]] = {}

    def push(self, c: str, at: int) -> None:
        self.where.setdefault(c, []).append(len(self.stack))
        self.stack.append((c, at))

    def closed_by(self, c: str, below: int) -> int:
        """The innermost place under ``below`` that c closes, -1 if there is none."""
        best = -1
        for o in _CLOSES.get(c, ""):
            at = self.where.get(o) or ()
            for k in reversed(at):
                if k < below:
                    best = max(best, k)
                    break
        return best

    def cut(self, k: int) -> None:
        """Forgets what stands from place k on."""
        for c, _ in self.stack[k:]:
            self.where[c].pop()
        del self.stack[k:]


def _units_of(text: str, a: int, e: int, events: list[int], k: int, out_a: list[int], out_e: list[int], langs: _Languages) -> int:
    """The units of one paragraph or list item text[a:e], which has no white space at its ends.

    events: positions of terminators, quotation marks, brackets (and spaces, where these can end units) in the whole
    text; k: the first to look at. Gives the first that was not looked at.
    """
    m = _MARKER.match(text, a, e)
    start, body = a, m.end() if m else a
    opened = _Open()
    stack = opened.stack
    pos = body
    last = len(events)
    while k < last:
        at = events[k]
        if at >= e:
            break
        k += 1
        if at < pos:
            continue
        c = text[at]
        pos = at + 1
        kind = _KIND.get(c) or ("gap" if c.isspace() else "term")
        if kind == "term":
            if not stack and pos + 1 < e:
                nxt = text[pos]
                if nxt == " ":  # the common case: a word, a terminator, a space, a capital letter
                    if text[pos + 1].isupper():
                        word = text[at - 5 : at]
                        if word.isalpha() and (c in "!?" or (c == "." and word.islower() and len(word) == 5 and word not in _FIVE)):
                            out_a.append(start)
                            out_e.append(pos)
                            start = body = pos = pos + 1
                            continue
                elif c in "。！？" and "\u3400" <= nxt <= "\u9fff":
                    out_a.append(start)
                    out_e.append(pos)
                    start = body = pos
                    continue
            pos = _TERM_RUN.match(text, at, e).end()
        if kind == "open":
            opened.push(c, at)
            continue
        if kind in ("both", "close"):
            if (i := opened.closed_by(c, len(stack))) >= 0:
                opened.cut(i)
            elif kind == "both":
                opened.push(c, at)
            continue
        if kind == "gap":
            if stack and stack[-1][0] not in "(（[":
                continue
            i = at - 1
            while i > start and _FORMAT.match(text[i]):
                i -= 1
            left, right = text[i], _SPACES.match(text, pos, e).end()
            if right < e and not _LATIN_DIGIT.match(text[right]) and (_SPACED_CHAR.match(left) or (_SPACED_CHAR.match(text[right]) and not _LATIN_DIGIT.match(left) and left not in ",;:–—-.!?…")):
                out_a.append(start)
                out_e.append(at)
                start = body = _WHITE.match(text, at, e).end()
                opened.cut(0)
            pos = right
            continue
        term = text[at:pos]
        close = _CLOSERS.match(text, pos, e).end()
        tail = text[pos:close]
        visible = tail.strip("​‌‍⁠﻿­") if tail else ""
        outer = False  # a quotation or bracket that began inside the sentence closes here
        left = len(stack)
        for c in visible:
            if (i := opened.closed_by(c, left)) >= 0:
                outer = outer or stack[i][1] > max(start, body)
                left = i
        if left:
            if stack[left - 1][1] > e - 2 or _unclosed(text, stack[left - 1], pos, e):
                opened.cut(left - 1)
                left = len(stack)
            else:
                if visible:
                    opened.cut(left)
                    pos = close
                continue
        opened.cut(left)
        pos = close
        gap = _SPACES.match(text, close, e).end()
        if gap >= e:
            break
        nxt = text[gap]
        spaced = any(c.isspace() for c in text[close:gap])
        dense = any(c in "。！？｡︒﹒﹗﹖．" for c in term) or (not spaced and any(c in "」』" for c in visible) and bool(_DENSE_CHAR.match(nxt)))
        if term.startswith("…") or "..." in term or ".." in term and len(term) > 1 and term.count(".") == len(term):
            continue  # an ellipsis with text after it ends nothing
        if visible and (nxt in ",;:，、；：" or nxt in "—–-"):
            continue
        if dense and not spaced:
            if visible and (outer or not nxt.isspace()) and _quoting(visible):
                if outer or not _starts_anew(nxt):
                    continue
            if nxt in ",;:，、；：)）":
                continue
            if not _DENSE_CHAR.match(text[at - 1]) and not _DENSE_CHAR.match(nxt) and not visible and nxt.islower():
                continue
        elif not spaced:
            if term in ".!?．" or all(c in ".!?" for c in term):
                if not (term[-1] in "!?" and _DENSE_CHAR.match(nxt)):
                    continue
        if visible and nxt.islower():
            continue
        if nxt.islower() and not visible and term[-1] in "!?" and stack:
            continue
        if term in ".．․﹒" and not _full_stop(text, start, at, pos, nxt, bool(visible), langs, (a, e)):
            continue
        if visible and outer and dense:
            continue
        out_a.append(start)
        out_e.append(close)
        start = body = _WHITE.match(text, close, e).end()
        opened.cut(0)
        pos = gap
    if start < e:
        out_a.append(start)
        out_e.append(e)
    return k


def _quoting(visible: str) -> bool:
    return any(c in "”’」』»\"" for c in visible)


def _starts_anew(nxt: str) -> bool:
    return nxt in "“「『《〈（(" or nxt.isupper()


def _unclosed(text: str, opened: tuple[str, int], pos: int, e: int) -> bool:
    """Whether the quotation or bracket is never closed in its paragraph; then it hides no sentence end."""
    return not any(text.find(c, pos, e) >= 0 for c in _PAIR[opened[0]])


def sentence_spans(text: str | None) -> tuple[list[int], list[int]]:
    """Starts and ends of the sentence units of a text, in code points."""
    starts: list[int] = []
    ends: list[int] = []
    if not text or text.isspace():
        return starts, ends
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _EVENTS_AND_SPACES if _HAS_GAPS.search(text) else _EVENTS
    events = np.flatnonzero(table[np.minimum(codes, len(table) - 1)]).tolist()
    langs = _Languages(text)
    a = k = 0
    for m in _PARAGRAPH.finditer(text):
        k = _paragraph(text, a, m.start(), events, k, starts, ends, langs)
        a = m.end()
    _paragraph(text, a, len(text), events, k, starts, ends, langs)
    return starts, ends


def _paragraph(text: str, a: int, e: int, events: list[int], k: int, starts: list[int], ends: list[int], langs: _Languages) -> int:
    while a < e and text[a].isspace():
        a += 1
    while e > a and text[e - 1].isspace():
        e -= 1
    return _units_of(text, a, e, events, k, starts, ends, langs) if a < e else k


def sentence_units(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, starts, ends) of each id's text: the offsets of its sentence units.

    A narrow scan: texts go through Arrow once and only offsets leave it. Repeated rows of one id are made one after
    that, by a shuffle of offsets, not of texts.
    """

    def spans(batches):
        for b in batches:
            found = [sentence_spans(t) for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind)], names=["id", "starts", "ends"])

    raw = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = raw.mapInArrow(spans, "id string, starts array<int>, ends array<int>")
    return out.groupBy("id").agg(F.max(F.struct("starts", "ends")).alias("u")).select("id", "u.starts", "u.ends")


def p1_found(spark, d):
    from ..runtime import table

    u = sentence_units(table(spark, d, "chunks"))
    return u.select(F.col("id").alias("chunk_id"), F.explode(F.arrays_zip("starts", "ends")).alias("u")).select("chunk_id", F.col("u.starts").alias("start_char"), F.col("u.ends").alias("end_char"))


def p1_sentence_counts(spark, d):
    """The right sentence count of each document's text beside the stored one."""
    from ..runtime import table

    docs = table(spark, d, "documents")
    n = sentence_units(docs, "document_id", "text").select(F.col("id").alias("document_id"), F.size("starts").alias("n_sentences"))
    stored = table(spark, d, "doc_profiles").groupBy("document_id").agg(F.max("sentence_count").alias("stored_count"))
    return n.join(stored, "document_id", "left")
