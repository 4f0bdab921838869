"""What jobs ask before they read or write: which files, which vocabulary, which outputs, which separators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.tokens import fingerprint
from textmill.operators.shuffle import shuffle
from textmill.operators.tokenize import byte_level_tokenizer, byte_tokenizer, separators, tokenize
from textmill.plans.tables import draw_sql, md5_key, table
from textmill.plans.tokens import ORACLES as TOKEN_ORACLES
from textmill.plans.tokens import _bytes_of, byte_level_vocab
from textmill.sinks.write import refuse_existing, write_corpus, write_shards
from textmill.sources.assets import read_merges, read_vocab
from textmill.sources.corpus import direct_files, read_corpus
from textmill.sources.files import expand_glob, resolve_inputs
from textmill.sources.packed import paired_prefixes
from textmill.staging import staging_root

SEED, FILES = 17, 6
BOS, EOS = 257, 256
HALVES = (".de", ".en", ".es", ".fr")
FEW = 30  # a language with fewer documents in a source than this has no output there


def _out(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def resolved_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that names one file twice, followed by the sorted matches of a glob."""
    out = _out(spark, "inputs")
    write_corpus(shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), FILES, SEED, "doc_id"), out)
    first = expand_glob(spark, f"{out}/part-00000*.parquet")[0]
    paths = resolve_inputs(spark, f"{first}:{first}", f"{out}/part-0000[0-3]*.parquet")
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return read_corpus(spark, paths).select(part.alias("file"), "doc_id", "text")


def every_other_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard of a glob's files."""
    out = _out(spark, "inputs")
    write_corpus(shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), FILES, SEED, "doc_id"), out)
    return read_corpus(spark, resolve_inputs(spark, glob=f"{out}/part-*.parquet", shard=1, n_shards=2))


def direct_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory stands for its own files, not for those of the folders in it."""
    out = _out(spark, "folder")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for k, folder in enumerate(("", "/inner")):
        write_corpus(docs.where(F.pmod("doc_id", F.lit(2)) == k), f"{out}/root{folder}", mode="append")
    return read_corpus(spark, direct_files(spark, f"{out}/root"))


def complete_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes (sources) and whether each has all its parts (languages), found from a listing with duplicates."""
    docs = table(spark, sf_dir, "documents")
    listing = docs.select(F.col("source").alias("prefix"), F.concat(F.lit("."), "lang").alias("ext"), "doc_id")
    frequent = listing.groupBy("prefix", "ext").agg(F.count("*").alias("n")).where(F.col("n") >= FEW // 10)
    return paired_prefixes(listing.join(frequent, ["prefix", "ext"]), HALVES)


def tokenize_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level encoding with the vocabulary and the merges read from files."""
    vocab, merges = byte_level_vocab()
    names, pairs = _out(spark, "vocab"), _out(spark, "merges")
    lines = "\n".join(["#version: 1", *[" ".join(m) for m in merges]])
    for value, folder in ((json.dumps(vocab), names), (lines, pairs)):
        spark.createDataFrame([(value,)], "value string").coalesce(1).write.text(folder)
    files = [expand_glob(spark, f"{folder}/part-*")[0] for folder in (names, pairs)]
    tokenizer = byte_level_tokenizer(spark, read_vocab(spark, files[0]), read_merges(spark, files[1]))
    tokens = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, eod=tokenizer.eos_id)
    return tokens.select("doc_id", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint"))


def _refused(check, *args, **named) -> bool:
    try:
        check(*args, **named)
    except ValueError:
        return True
    return False


def outputs_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which languages' outputs exist, and so are refused; the others have few documents and were not written."""
    out = _out(spark, "outputs")
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_documents"))
    docs = table(spark, sf_dir, "documents").join(F.broadcast(counts), "lang")
    write_shards(docs.where(F.col("n_documents") >= FEW), out, "lang")
    languages = sorted(r["lang"] for r in counts.collect())
    refused = [(x, _refused(refuse_existing, spark, out, [f"lang={x}"])) for x in [*languages, "none"]]
    found = spark.createDataFrame(refused, "lang string, refused boolean")
    return found.join(counts, "lang", "left").select("lang", "refused", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def separated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents between both special ids; asking for fewer than a separation needs is refused."""
    tokenizer = byte_tokenizer(EOS, BOS)
    refused = [_refused(separators, spark, tokenizer), _refused(separators, spark, tokenizer, use_eos_id=True)]
    before, after = separators(spark, tokenizer, use_bos_id=True, use_eos_id=True)
    tokens = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, before=before, after=after)
    return tokens.select(
        "doc_id", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint"), F.lit(all(refused)).alias("refused")
    )


QUERIES = {
    "resolved_inputs": resolved_inputs,
    "every_other_file": every_other_file,
    "direct_files_only": direct_files_only,
    "complete_prefixes": complete_prefixes,
    "tokenize_with_files": tokenize_with_files,
    "outputs_refused": outputs_refused,
    "separated_documents": separated_documents,
}

_FILE = f"({draw_sql(md5_key(SEED, 'doc_id'))} * {FILES}) // 4294967296"

ORACLES = {
    "resolved_inputs": f"""
        with placed as (select {_FILE} as file, doc_id, text from documents)
        select * from placed where file < 4
        union all select * from placed where file = 0
        union all select * from placed where file = 0""",
    "every_other_file": f"select doc_id, text from documents where {_FILE} % 2 = 1",
    "direct_files_only": "select doc_id, text from documents where doc_id % 2 = 0",
    "complete_prefixes": f"""
        with counted as (select source, lang from documents group by 1, 2 having count(*) >= {FEW // 10})
        select source as prefix, count(*) = {len(HALVES)} as complete from counted group by 1""",
    "tokenize_with_files": TOKEN_ORACLES["tokenize_byte_level"],
    "outputs_refused": f"""
        select lang, count(*) >= {FEW} as refused, count(*) as n_documents from documents group by 1
        union all select 'none', false, 0""",
    "separated_documents": f"""
        select doc_id, octet_length(encode(text)) + 2 as n_tokens,
            md5(array_to_string(list_concat([{BOS}], {_bytes_of('text')}, [{EOS}]), ',')) as fingerprint, true as refused
        from documents""",
}
