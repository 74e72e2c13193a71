"""The queries of this subpackage and the SQL that gives their rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digest
from .cluster import scratch
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle, restored
from .fingerprint import fingerprint_edits
from .line_dedup import line_dedup
from .mixing import mixture
from .ngram_join import ngram_join
from .periodic import periodic_runs
from .quality import quality
from .suffix_dedup import suffix_dedup
from .token_records import token_record_digest, write_token_records
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality(docs, labels, host=F.col("source"), path=F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "token-records")
    write_token_records(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return token_record_digest(spark, out)


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"))[0]


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["quality", "toxic"], decide_by="toxic")
    return scored.select("doc_id", "p_quality", "p_toxic", "toxic")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which the words of one document in ten, by its id, repeat from some word on."""
    words, n, g = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), F.size("words"), F.floor(F.col("h") / 10)
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(_table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("top.shorter")
    exponent = F.floor(1000 * length / F.col("top.period")).cast("long")
    return found.select("doc_id", "n_runs", "top.start", length.alias("length"), "top.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_quality_classifier, op4_token_id_output, op5_mixing_sources, op6_toxicity, op7_exact_dedup,
        op8_embedding_near_dedup, op9_line_dedup, op10_byte_level_bpe, op11_document_fingerprints, op12_fill_in_middle, op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op7_exact_dedup": """
        select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
          count(*) over (partition by coalesce(text, '')) as group_size,
          doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
          sha256(coalesce(text, '')) as text_sha256
        from documents where doc_id is not null""",
    "op9_line_dedup": r"""
        with rows as (select doc_id, text, string_split(text, chr(10)) as l from documents where doc_id is not null and text is not null),
        windows as (select doc_id, unnest(range(1, len(l) - 1)) as pos, l from rows where len(l) >= 3),
        named as (select doc_id, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] as w from windows
          where trim(l[pos] || l[pos + 1] || l[pos + 2], ' ') <> ''),
        later as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as k from named) where k > 1),
        gone as (select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as pos from later),
        lines as (select doc_id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as line from rows),
        kept as (select l.doc_id, string_agg(line, chr(10) order by l.pos) as text, count(*) as n from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos
          where g.pos is null group by l.doc_id)
        select d.doc_id, cast(len(string_split(d.text, chr(10))) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.text, '')) as text_sha256
        from rows d left join kept k on d.doc_id = k.doc_id
        union all select doc_id, 0, null from documents where doc_id is not null and text is null""",
    "op11_document_fingerprints": """
        with rows as (select doc_id, coalesce(text, '') as text from documents where doc_id is not null),
        ordered as (select doc_id, text, coalesce(lead(text) over w, first_value(text) over w) as after from rows window w as (order by doc_id desc)),
        edited as (select *, substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2) as new from ordered),
        sets as (select *, list_distinct(list_filter(string_split(text, chr(10)), lambda x: x <> '')) as a, list_distinct(list_filter(string_split(new, chr(10)), lambda x: x <> '')) as b,
          list_distinct(list_filter(string_split(after, chr(10)), lambda x: x <> '')) as c from edited),
        keys as (select doc_id, side, ('0x' || substr(md5(line), 1, 15))::bigint as k
          from (select doc_id, 'a' as side, unnest(a) as line from sets union all select doc_id, 'b', unnest(b) from sets)),
        checks as (select *, ('0x' || substr(md5('0:' || k), 1, 15))::bigint as c from keys),
        cells as (select doc_id, side, j * 8 + ((c >> (9 * j)) & 7) as cell, bit_xor(k) as k, bit_xor(c) as c, count(*) as n from checks, (select unnest([0, 1, 2]) as j) group by all),
        prints as (select doc_id, side, string_agg(printf('%02x%015x%08x%x', cell, k, c >> 28, n), ',' order by cell) as p from cells group by all)
        select s.doc_id, length(text) as n_chars, sha256(new) as edited_sha256, coalesce(p.p, '') as fingerprint, coalesce(q.p, '') as edited_fingerprint,
          case when len(a) + len(b) = 0 then 1.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end::double as near_edited,
          case when len(a) + len(c) = 0 then 1.0 else len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))) end::double as near_next
        from sets s left join prints p on s.doc_id = p.doc_id and p.side = 'a' left join prints q on s.doc_id = q.doc_id and q.side = 'b'""",
    "op12_fill_in_middle": r"""
        with rows as (select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as h from documents where doc_id is not null),
        units as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as u,
          ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 25, 8))::bigint as h4 from rows),
        formed as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
          least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from units),
        cut as (select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:], ''), '') as suffix from formed)
        select doc_id, len(u) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
          sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
          sha256(text) as restored_sha256 from cut""",
}
