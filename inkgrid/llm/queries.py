"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import containers, language, lookalikes, mixture, neighbours, pieces, scans, sentences, truncation

QUERIES = {
    "p1_found": sentences.p1_found,
    "p1_sentence_counts": sentences.p1_sentence_counts,
    "p2_found": language.p2_found,
    "p2_languages": language.p2_languages,
    "p4_found": neighbours.p4_found,
    "p4_neighbours": neighbours.p4_neighbours,
    "p5_found": lookalikes.p5_found,
    "p5_canonical": lookalikes.p5_canonical,
    "p6_found": scans.p6_found,
    "p6_paragraphs": scans.p6_paragraphs,
    "p7_found": pieces.p7_found,
    "p7_pieces": pieces.p7_pieces,
    "p10_found": truncation.p10_found,
    "p10_sources": truncation.p10_sources,
    "p8_containers": containers.p8_containers,
    "p8_small_containers": containers.p8_small_containers,
    "p8_fill": containers.p8_fill,
    "p9_mixture": mixture.p9_mixture,
    "p9_shares": mixture.p9_shares,
}

SQL = {
    "p7_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(content) > (SELECT max_chars FROM size_limits WHERE item = 'chunk')",
}
