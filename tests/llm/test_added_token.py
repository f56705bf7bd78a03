"""op4 and the pipeline's packing give the ids of the tokenizer with its own
settings, its added token included."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from earnlens.llm import queries


def test_ids_of_texts_with_the_added_token(spark, tmp_path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [None, "", end, f"a{end}b", f"  two {end}{end}\n\n{end} \t x", f"<|endoftext|{end}", "<|endoftext|", f"é  {end}  don't{end}",
             f"long word {end}" * 1500, f"{end.upper()} <|im_start|>"]
    want = {}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (queries.op4_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.collect()} == want
