import zlib

from inkgrid.operators.pdf import pdf_text
from inkgrid.operators.providers import default_extract


def pdf(pages, packed=True, cmap=None):
    """A small file of one content stream a page."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    if cmap:
        objects[3] = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>"
        objects[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    kids = []
    for k, content in enumerate(pages):
        raw = zlib.compress(content) if packed else content
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * k)
        objects[11 + 2 * k] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), b" /Filter /FlateDecode" if packed else b"", raw)
        kids.append(b"%d 0 R" % (10 + 2 * k))
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


ONE = b"BT /F1 12 Tf 72 700 Td (First line \\(one\\)) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line)] TJ T* (caf\\351 (nested)) Tj ET"
TWO = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm <48656C6C6F> Tj 1 0 0 1 110 700 Tm ( there) Tj 1 0 0 1 72 680 Tm (next) Tj ET"


def test_lines_and_pages():
    for packed in (True, False):
        assert pdf_text(pdf([ONE, TWO], packed)) == "First line (one)\nSecond line\ncaf\u00e9 (nested)\fHello there\nnext"


def test_fonts_with_a_unicode_map():
    cmap = b"1 beginbfchar <0001> <0416> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    assert pdf_text(pdf([b"BT /F1 9 Tf <0001001000110012> Tj ET"], cmap=cmap)) == "\u0416abc"


def test_objects_in_streams():
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [5 0 R] >>"), (5, b"<< /Type /Page /Contents 6 0 R >>")]
    head, body = b"", b""
    for n, x in inner:
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    raw = zlib.compress(head + body)
    text = b"BT (inside) Tj ET"
    data = b"%%PDF-1.5\n9 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n6 0 obj\n<< /Length 1 >>\nstream\n%s\nendstream\nendobj\n" % (len(head), raw, text)
    assert pdf_text(data) == "inside"


def test_what_has_no_text():
    assert pdf_text(b"%PDF-1.4\nbroken") == "" and pdf_text(b"%PDF-1.4 trailer << /Encrypt 5 0 R >>") == ""
    assert pdf_text(pdf([b""])) == "" and pdf_text(pdf([ONE], True).replace(b"FlateDecode", b"DCTDecode  ")) == ""
    assert default_extract([b"plain\ntext", pdf([TWO]), bytearray(b"%PDF-1.4")]) == ["plain\ntext", "Hello there\nnext", ""]


def test_budgets_in_tokens_of_a_vocabulary(spark, tmp_path):
    import base64

    from inkgrid.operators import segment

    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))  # one token a byte
    lines = spark.createDataFrame([("d", 2 * i, 1, "ab cd") for i in range(6)] + [("d", 2 * i + 1, 1, "") for i in range(6)], "document_id string, line_no int, page int, text string")
    by_words = segment.chunk_documents(lines, "paragraph", 4, 1).count()
    c = segment.chunk_documents(lines, "paragraph", 10, 1, ranks_file=str(ranks)).collect()
    assert by_words == 3 and len(c) == 3 and {r["token_count"] for r in c} == {12}
    assert segment.chunk_documents(lines, "sentence", 5, 1, ranks_file=str(ranks)).count() == 6
