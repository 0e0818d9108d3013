"""The registered queries of the operators, over their whole tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontaminate, exact_dedup, lang_id, licenses, line_dedup, merkle, ngram_join, packing, pii, secret_scan, token_files, toxicity, whitening
from runlens.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return wrap


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lang_id.detect(docs, spans=True).select("doc_id", "held_out", "lang_pred", "score", "spans")


@query("""
    with d as (select doc_id, coalesce(text, '') as t from documents)
    select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
           doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
    from d
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack_documents(docs, tokenizer_path())


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.detect(docs, labels)


@query()
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet"), pii.train_from(pii.training_table(spark)))


@query()
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.contamination(docs, benchmark)


@query()
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query()
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query()
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.document_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("""
    with recursive fields as (
        select doc_id, lang, rowid_, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as a,
               n_chars, coalesce(strlen(text) || ':' || text, '-') as z
        from (select *, row_number() over () as rowid_ from documents)),
    leaves as (
        select doc_id, lang, rowid_, sha256(a || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) as leaf, doc_id::varchar as id, n_chars, a, z from fields),
    crc_table as (
        select i::ubigint as i, list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]), lambda c, k: xor(c >> 1, (c & 1) * 3988292384::ubigint)) as c from range(256) t(i)),
    crcs as (
        select rowid_, id, 0 as k, 4294967295::ubigint as c from leaves where id is not null
        union all
        select rowid_, id, k + 1, xor(crcs.c >> 8, t.c) from crcs join crc_table t on t.i = xor(crcs.c & 255, ascii(id[k + 1])::ubigint) where k < length(id)),
    numbered as (
        select l.*, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
               sha256(a || coalesce(strlen((n_chars::hugeint + if(xor(c.c, 4294967295::ubigint) % 7 = 0, 1, 0))::varchar) || ':' || (n_chars::hugeint + if(xor(c.c, 4294967295::ubigint) % 7 = 0, 1, 0)), '-') || z) as forged
        from leaves l left join (select rowid_, c from crcs where k = length(id)) c using (rowid_)),
    up(tree, level, pos, h, n) as (
        select coalesce('v' || lang, 'n'), 0, pos, leaf, count(*) over (partition by lang) from numbered
        union all
        select tree, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from up where n > 1 group by tree, level, pos // 2, n),
    tops(level, pos, h, n) as (
        select 0, row_number() over (order by tree) - 1, h, count(*) over () from up where n = 1
        union all
        select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from tops where n > 1 group by level, pos // 2, n),
    places as (select tree, level as height, h as subroot, row_number() over (order by tree) - 1 as tpos from up where n = 1),
    base as (
        select l.rowid_, l.doc_id, l.leaf, coalesce(l.forged, l.leaf) as forged, l.pos, p.* from numbered l join places p on p.tree = coalesce('v' || l.lang, 'n')),
    siblings as (
        select b.rowid_, u.level as i, (b.pos >> u.level::bigint) & 1 as side, s.h from base b join (select distinct tree, level from up where n > 1) u using (tree)
        left join up s on s.tree = b.tree and s.level = u.level and s.pos = xor(b.pos >> u.level::bigint, 1)
        union all
        select b.rowid_, b.height + u.level, (b.tpos >> u.level::bigint) & 1, s.h from base b cross join (select distinct level from tops where n > 1) u
        left join tops s on s.level = u.level and s.pos = xor(b.tpos >> u.level::bigint, 1)),
    proofs as (select rowid_, string_agg(h, '' order by i) as proof, count(*) as steps from siblings group by 1),
    folded(rowid_, i, h) as (
        select rowid_, 0, forged from base
        union all
        select f.rowid_, f.i + 1, sha256(if(s.side = 1, coalesce(s.h, '') || f.h, f.h || coalesce(s.h, ''))) from folded f join siblings s on s.rowid_ = f.rowid_ and s.i = f.i)
    select b.doc_id, b.leaf, b.subroot, t.h as root, sha256(coalesce(p.proof, '')) as proof_sha256, f.h as folded_root, f.h = t.h as verified
    from base b left join proofs p using (rowid_) join folded f on f.rowid_ = b.rowid_ and f.i = coalesce(p.steps, 0) cross join (select h from tops where n = 1) t
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, 1).otherwise(0)
    forged = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + more}
    return merkle.verify(merkle.manifest(docs, forged=forged))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query()
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_files.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path())
    return token_files.documents(spark, path)
