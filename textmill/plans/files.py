"""Round trips through files: what is written and read back equals the SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.tokens import fingerprint
from textmill.operators.indexed import indexed_datasets
from textmill.operators.merge import merge_indexed
from textmill.operators.pack import pack
from textmill.operators.position import with_line_position, with_scan_position
from textmill.operators.shuffle import shuffle
from textmill.operators.split import split
from textmill.operators.tokenize import byte_tokenizer
from textmill.plans.splitting import _MARKED, RIGHT_MAX, RIGHT_PROB
from textmill.plans.tables import NUMBERED, draw_sql, md5_key, table
from textmill.plans.tokens import _SHOWN, _WORD_DOCS, EOD, WORD_LENGTH, _bytes_of, _samples, printed, word_tokens
from textmill.session import spread_if_small
from textmill.sinks.write import in_order, write_corpus, write_per_file, write_split
from textmill.sources.corpus import decompress_json, read_corpus
from textmill.sources.packed import read_packed, read_parts
from textmill.sources.streams import read_streams
from textmill.staging import staging_root

SEED = 5
FILES = 6
CHUNKS = 7
CODECS = (None, "snappy", "gzip", "none")


def _out(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def _file_number() -> Column:
    """Number of the output file a row was read from."""
    return F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _out(spark, "json")
    write_corpus(spread_if_small(table(spark, sf_dir, "documents").select("doc_id", "text")), out, "json")
    return read_corpus(spark, out, "json", "doc_id long, text string")


def json_line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of JSON lines, read in ranges of half a megabyte; the files hold the documents in random order."""
    out = _out(spark, "lines")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    write_corpus(shuffle(docs, FILES, SEED, "doc_id"), out, "json", "none")
    return with_line_position(read_corpus(spark, out, "json", "doc_id long, lang string, text string"), range_bytes=1 << 19)


def gzip_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, plain = _out(spark, "gzip"), _out(spark, "plain")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    write_corpus(spread_if_small(docs), packed, "json", "gzip")
    return decompress_json(spark, packed, plain, "doc_id long, lang string, text string")


def shuffled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _out(spark, "shuffled")
    write_corpus(shuffle(table(spark, sf_dir, "documents"), FILES, SEED, "doc_id"), out)
    return read_corpus(spark, out).select(_file_number().alias("file"), "doc_id", "text")


def chunks_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _out(spark, "chunks")
    docs = table(spark, sf_dir, "documents")
    write_corpus(in_order(with_scan_position(docs), "pos", docs.count(), CHUNKS), out)
    return read_corpus(spark, out).select(_file_number().alias("file"), "pos", "doc_id", "text")


def split_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _out(spark, "split")
    write_split(split(table(spark, sf_dir, "documents"), "doc_id", RIGHT_PROB, RIGHT_MAX), out)
    return read_corpus(spark, out).select("doc_id", "lang", "text", "split")


def stream_root_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _out(spark, "streams")
    marked = split(table(spark, sf_dir, "documents"), "doc_id", RIGHT_PROB, RIGHT_MAX)
    named = marked.select(
        "doc_id", "text", F.col("lang").alias("stream"), F.when(F.col("is_right"), "val").otherwise("train").alias("split")
    )
    named.write.partitionBy("stream", "split").parquet(out)
    return read_streams(spark, out, "val", ["de", "en", "gsw"])


def _datasets(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    paths = [f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet"]
    return indexed_datasets(spark, paths, byte_tokenizer(), "parquet", schema="text string", eod=EOD, by_file=by_file)


def tokenize_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _datasets(spark, sf_dir).select(
        "file_idx", "item_idx", "doc_idx", "size", fingerprint(F.col("tokens")).alias("fingerprint")
    )


def merge_tokenized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _out(spark, "datasets")
    write_per_file(_datasets(spark, sf_dir, by_file=True), out, "corpus", 2, key="text", compact=False)
    merged = merge_indexed(read_corpus(spark, out), "output")
    return merged.select("output", "merged_idx", "item_idx", "size", fingerprint(F.col("tokens")).alias("fingerprint"))


def merge_root_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge from the root alone: one scan, counts and types by footers."""
    out = _out(spark, "root")
    write_per_file(_datasets(spark, sf_dir, by_file=True), out, "corpus", 2, key="text", compact=False)
    items, counts = read_parts(spark, out)
    merged = merge_indexed(items, "output", counts=counts)
    return merged.select("output", "merged_idx", "item_idx", "size", fingerprint(F.col("tokens")).alias("fingerprint"))


def nested_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to folders in folders, and read with one recursive scan."""
    out = _out(spark, "nested")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for k, folder in enumerate(("", "/a", "/a/b")):
        write_corpus(docs.where(F.pmod("doc_id", F.lit(3)) == k), f"{out}/root{folder}", mode="append")
    return read_corpus(spark, f"{out}/root", recurse=True)


def packed_long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples kept as 64-bit ids, read as a packed dataset."""
    out = _out(spark, "packed")
    samples = pack(word_tokens(spark, sf_dir), WORD_LENGTH)
    write_corpus(samples.withColumn("tokens", F.col("tokens").cast("array<bigint>")), out)
    packed, kind = read_packed(spark, out)
    return printed(packed).withColumn("kind", F.lit(f"{kind} {packed.schema['tokens'].dataType.simpleString()}"))


def subset_of_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inner dataset of a partitioned root."""
    out = _out(spark, "subsets")
    table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("subset")).write.partitionBy(
        "subset"
    ).parquet(out)
    return read_corpus(spark, out, subset="de")


def codecs_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents under every codec name; the files say what they were packed with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = None
    for codec in CODECS:
        out = _out(spark, "codec")
        write_corpus(docs, out, codec=codec)
        packed = F.regexp_extract("_metadata.file_name", r"\.(\w+)\.parquet$", 1).alias("codec")
        one = read_corpus(spark, out).select("doc_id", "text", packed)
        found = one if found is None else found.unionByName(one)
    return found


QUERIES = {
    "nested_folders": nested_folders,
    "packed_long_ids": packed_long_ids,
    "subset_of_root": subset_of_root,
    "codecs_written": codecs_written,
    "json_roundtrip": json_roundtrip,
    "json_line_positions": json_line_positions,
    "gzip_json_ingest": gzip_json_ingest,
    "shuffled_files": shuffled_files,
    "chunks_written": chunks_written,
    "split_written": split_written,
    "stream_root_scan": stream_root_scan,
    "tokenize_files": tokenize_files,
    "merge_tokenized_files": merge_tokenized_files,
    "merge_root_parts": merge_root_parts,
}

_ITEMS = f"""
    items as (
        select cast(0 as bigint) as file_idx, row_number() over (order by item_id) - 1 as item_idx, text
        from benchmark
        union all
        select 1, row_number() over (order by doc_id) - 1, text from documents)"""

ORACLES = {
    "nested_folders": "select doc_id, text from documents",
    "packed_long_ids": f"""
        with {_WORD_DOCS}, {_samples(WORD_LENGTH)}
        select *, 'tokens array<int>' as kind from ({_SHOWN} where n_tokens = {WORD_LENGTH})""",
    "subset_of_root": "select doc_id, text from documents where lang = 'de'",
    "codecs_written": """
        select doc_id, text, codec from documents, (values ('zstd'), ('snappy'), ('gz'), ('')) c(codec)""",
    "json_roundtrip": "select doc_id, text from documents",
    "json_line_positions": f"""
        select doc_id, lang, text, row_number() over (order by {md5_key(SEED, 'doc_id')}, doc_id) - 1 as pos
        from documents""",
    "gzip_json_ingest": "select doc_id, lang, text from documents",
    "shuffled_files": f"""
        select ({draw_sql(md5_key(SEED, 'doc_id'))} * {FILES}) // 4294967296 as file, doc_id, text from documents""",
    "chunks_written": f"""
        with {NUMBERED}, sized as (select count(*) // {CHUNKS} as q, count(*) % {CHUNKS} as r from documents)
        select case when pos < r * (q + 1) then pos // (q + 1)
            else r + (pos - r * (q + 1)) // greatest(q, 1) end as file, pos, doc_id, text
        from numbered, sized""",
    "split_written": f"""
        with {_MARKED}
        select doc_id, lang, text, case when is_right then 'valid' else 'train' end as split from marked""",
    "stream_root_scan": f"""
        with {_MARKED}
        select doc_id, text, lang as stream, 'val' as split from marked
        where is_right and lang in ('de', 'en', 'gsw')""",
    "tokenize_files": f"""
        with {_ITEMS}
        select file_idx, item_idx, item_idx as doc_idx, cast(octet_length(encode(text)) + 1 as integer) as size,
            md5(array_to_string(list_concat({_bytes_of('text')}, [{EOD}]), ',')) as fingerprint
        from items""",
    "merge_tokenized_files": f"""
        with {_ITEMS}
        select 'corpus_' || cast(file_idx as varchar) || '_text_document' as output,
            row_number() over (order by file_idx, item_idx) - 1 as merged_idx, item_idx,
            cast(octet_length(encode(text)) + 1 as integer) as size,
            md5(array_to_string(list_concat({_bytes_of('text')}, [{EOD}]), ',')) as fingerprint
        from items""",
}
ORACLES["merge_root_parts"] = ORACLES["merge_tokenized_files"]
