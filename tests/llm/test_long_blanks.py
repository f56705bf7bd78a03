"""Texts with very long white space runs are packed like any other."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from earnlens.llm import queries

TEXTS = [" " * 2_000_000 + "x", "\n" * 1_200_000, "a" + " \n" * 1_000_000 + "b", "plain"]


def whole(rows):
    """Pieces per document, with the ids' count."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        out.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    return out


def expected():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {}
    for i, text in enumerate(TEXTS):
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        out[i] = [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:])]
    return out


def test_packing_and_the_pipelines_stage(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    assert whole(queries.pack_documents(df, queries.ADDED).collect()) == expected()
    packed = dict(corpus_pipeline.STAGES)["packing"]
    assert whole(packed(spark, df, "").collect()) == expected()
