"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earnlens.llm import (chat, exact_dedup, html_extract, line_dedup, minhash_dedup, packing, periodic_runs, pieces, posting_lists, substring_dedup,
                          token_alignment, topk_search, toxicity)
from earnlens.llm.common import bounded_batches, read_table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = bounded
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op5_exact_dedup", r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as s from documents)
select doc_id, min(doc_id) over (partition by s) as keep_id, count(*) over (partition by s) as group_size,
       doc_id = min(doc_id) over (partition by s) as kept, s as text_sha256
from t""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), hash_all=True)


@query("op6_line_dedup", """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
h as (select key, max(doc_id) as top from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, h.key is not null and k.doc_id <> h.top as gone from k left join h on k.key = h.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_minhash_dedup", r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as sh from p),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from o join n x on o.a = x.doc_id join n y on o.b = y.doc_id where 100 * o.n >= 85 * (x.n + y.n - o.n)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as v, doc_id as c from documents union select r.v, u.b from r join u on r.c = u.a),
m as (select v, min(c) as c from r group by v)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from documents d left join n on d.doc_id = n.doc_id join m on d.doc_id = m.v""")
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op10_substring_dedup", r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35),
k as (select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from p),
r as (select doc_id, i from (select *, count(*) over (partition by h) as n from k) where n > 1),
c as (select distinct doc_id, unnest(range(i, i + 35)) as j from r),
x as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as j from w),
y as (select x.doc_id, x.j, x.ws[x.j] as word, c.j is not null as gone from x left join c on x.doc_id = c.doc_id and x.j = c.j),
z as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by j) filter (where not gone) as kept
      from y group by doc_id)
select w.doc_id, len(w.ws) as n_words, coalesce(z.n_removed, 0) as n_removed, sha256(coalesce(z.kept, '')) as kept_sha256
from w left join z on w.doc_id = z.doc_id""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeated_runs(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), ADDED)


#: The token that byte_bpe_50k.json adds to the ranks.
ADDED = {"<|endoftext|>": 50256}


def pack_documents(docs: DataFrame, added: dict[str, int] | None = None) -> DataFrame:
    """Documents packed with the 50k byte-level vocabulary; ``added`` as in
    :func:`packing.tokenised_pieces`."""
    import public_tokenizers
    pieces = packing.tokenised_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)
    return packing.pack(pieces)


def held_out() -> Column:
    """Rows whose crc32(doc_id as text) modulo 3 is 1 are not learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


#: Texts scored so or higher are toxic.
TOXIC = 0.7


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out())


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
                      F.col("spans").alias("toxic_spans"))


def _escaped(column: str) -> str:
    """SQL that escapes as :func:`chat.escape` does."""
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


@query("op3_chat_format", f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum({len(chat.render('', '')[0])} + length({_escaped('role')}) + length({_escaped('text')})) as bigint) as formatted_chars
from c group by conv_id""")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    messages = chat.fold_events(chat.turns_as_events(turns.unionByName(more)))
    return chat.read_back(chat.format_chats(messages))


@query("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(read_table(spark, sf_dir, "pages"))


@query("op7_topk_search", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
      from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank", vec_id, score from s)
select query_id, "rank", vec_id, score from r where "rank" <= 20""")
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    good = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = rows.where(good).select(F.col("vec_id").cast("long").alias("id"), F.transform(
        "embedding", lambda x: F.floor(64 * x.cast("double")).cast("long")).alias("v"))
    return topk_search.top_k(vectors, vectors.where("id % 20 = 0"), 20)


@query("op9_piece_encoding")
def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pieces.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten repeats from word ``a`` on with period ``p``."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * ((n - a) // p + 1))[:n - a]


@query("op11_periodic_runs", r"""
with recursive c as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(cast(doc_id as varchar), ''),
             lambda ch: [cast(ascii(ch) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda s, x: case when x >= 0 then xor(s, x) else xor(s >> 1, 3988292384::bigint * (s & 1)) end), 4294967295::bigint) as h
  from documents),
d as (select doc_id, ws, len(ws) as n, h, h // 10 as g, case when len(ws) > 0 then (h // 10) % len(ws) end as a from c),
e as (select *, 1 + (n - a) // (3 + g % 8) as p from d),
w as (select doc_id, n, i, case when h % 10 = 0 and i >= a then ws[a + (i - a) % p + 1] else ws[i + 1] end as word
      from (select *, unnest(range(n)) as i from e)),
m as (select x.doc_id, y.i - x.i as q, x.i from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 3),
s as (select doc_id, q, min(i) as start, count(*) + q as length
      from (select *, i - row_number() over (partition by doc_id, q order by i) as island from m) group by doc_id, q, island),
r as (select doc_id, start, length, min(q) as period from s where length >= greatest(24, 3 * q) group by doc_id, start, length),
t as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from r group by doc_id),
b as (select x.* from r x where not exists (select 1 from r y where x.doc_id = y.doc_id and
      (y.length * x.period > x.length * y.period or (y.length * x.period = x.length * y.period and (y.start < x.start or (y.start = x.start and y.period < x.period)))))),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from r),
k as (select w.doc_id, string_agg(word, ' ' order by w.i) as kept from w left join gone on w.doc_id = gone.doc_id and w.i = gone.i
      where gone.i is null group by w.doc_id)
select d.doc_id, coalesce(t.n_runs, 0) as n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period as exponent_milli,
       sha256(coalesce(t.runs, '')) as runs_sha256, sha256(coalesce(k.kept, '')) as collapsed_sha256
from d left join t on d.doc_id = t.doc_id left join b on d.doc_id = b.doc_id left join k on d.doc_id = k.doc_id""")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents"), rewrite=with_planted_run)
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = token_alignment.align_documents(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"))
    return out.drop("groups")


@query("op13_nearest_neighbours")
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    good = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = rows.where(good).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return posting_lists.nearest(vectors, vectors.where("id % 100 = 0"), 10)
