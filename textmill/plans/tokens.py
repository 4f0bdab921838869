"""Tokenising, packing and token audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.tokens import fingerprint, words
from textmill.functions.workers import byte_symbols, hex_bytes
from textmill.operators.audit import text_audit, token_range_audit, token_report
from textmill.operators.cut import PIECE_COL, cut_texts
from textmill.operators.pack import pack, pack_report, text_samples
from textmill.operators.position import with_position, with_scan_position
from textmill.operators.sharding import assign_shard
from textmill.operators.tokenize import (
    END_OF_TEXT,
    bpe_tokenizer,
    byte_level_tokenizer,
    byte_tokenizer,
    callable_tokenizer,
    map_partitions_of_texts,
    separators,
    tokenize,
    word_hash_tokenizer,
)
from textmill.plans.tables import NUMBERED, table
from textmill.staging import stage

SHARDS = 4
WORD_LENGTH = 512
BYTE_LENGTH = 2048
EOD = 256
PIECE_CHARS = 4096
BOS, EOS = 1 << 28, (1 << 28) + 1
BOS_TEXT, EOS_TEXT = "<page>", "\n"

# Ranked byte merges of the small encoder, each a pair of hex-coded symbols.
MERGES = [
    ("65", "6e"),
    ("65", "72"),
    ("6f", "6e"),
    ("74", "68"),
    ("c3", "a9"),
    ("c3", "a8"),
    ("65", "73"),
    ("69", "6e"),
    ("61", "75"),
    ("74", "69"),
    ("7469", "6f6e"),
    ("7468", "65"),
    ("65", "6175"),
    ("6d", "656e"),
    ("6d656e", "74"),
]

# The same for the byte-level encoder, whose words keep the space before them.
BYTE_LEVEL_MERGES = [
    ("20", "74"),
    ("68", "65"),
    ("2074", "6865"),
    ("69", "6e"),
    ("65", "72"),
    ("c3", "a9"),
    ("6f", "6e"),
    ("20", "61"),
    ("2061", "6e"),
    ("c3", "bc"),
    ("20", "64"),
    ("2064", "6572"),
]


def small_vocab() -> dict[str, int]:
    """All bytes, then the merged symbols in rank order."""
    symbols = [f"{b:02x}" for b in range(256)] + [a + b for a, b in MERGES]
    return {s: i for i, s in enumerate(symbols)}


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in stream order, sharded by striding, as framed word ids."""
    docs = assign_shard(with_scan_position(table(spark, sf_dir, "documents")), SHARDS)
    tokens = tokenize(docs.select("doc_id", "shard", "pos", "text"), word_hash_tokenizer(), before=[BOS], after=[EOS])
    return stage(tokens, "word-tokens")


def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = assign_shard(with_scan_position(table(spark, sf_dir, "documents")), SHARDS)
    return stage(tokenize(docs.select("shard", "pos", "text"), byte_tokenizer(), eod=EOD), "byte-tokens")


def printed(samples: DataFrame) -> DataFrame:
    return samples.select("shard", "seq", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint"))


def tokenize_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = tokenize(docs, byte_tokenizer())
    return tokens.select("doc_id", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint"))


def tokenize_bytes_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenize(table(spark, sf_dir, "documents").select("lang", "text"), byte_tokenizer())
    return token_report(tokens, "lang")


def tokenize_pages_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return tokenize(pages, byte_tokenizer(), text_col="html", eod=EOD).select(
        "page_id", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint")
    )


def tokenize_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe_tokenizer(spark, small_vocab(), MERGES, to_symbols=hex_bytes)
    tokens = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)
    return tokens.select("doc_id", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint"))


def byte_level_vocab() -> tuple[dict[str, int], list[tuple[str, str]]]:
    """The small byte-level encoder as its files would hold it: printable symbols, merges, end token."""
    spelled = byte_symbols()

    def shown(code: str) -> str:
        return "".join(spelled[b] for b in bytes.fromhex(code))

    merges = [(shown(a), shown(b)) for a, b in BYTE_LEVEL_MERGES]
    return {s: i for i, s in enumerate([*spelled, *(a + b for a, b in merges), END_OF_TEXT])}, merges


def tokenize_byte_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level encoding with leading spaces, ended by the vocabulary's own end token."""
    tokenizer = byte_level_tokenizer(spark, *byte_level_vocab())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = tokenize(docs, tokenizer, eod=tokenizer.eos_id)
    return tokens.select("doc_id", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint"))


def tokenize_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokeniser that is any Python function: here one id per character."""

    def load():
        return lambda texts: [[ord(c) for c in text] for text in texts]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = tokenize(docs, callable_tokenizer(load, 0x110000))
    return tokens.select("doc_id", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint"))


def preprocess_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An own preprocessing function over batches of documents: here their lines, counted."""

    def count_lines(batches):
        for pdf in batches:
            yield pdf[["doc_id"]].assign(n_lines=pdf["text"].str.count("\n") + 1)

    docs = table(spark, sf_dir, "documents")
    return map_partitions_of_texts(docs, count_lines, "doc_id long, n_lines long", ["doc_id", "text"])


def pack_words_bos_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(pack(word_tokens(spark, sf_dir), WORD_LENGTH))


def pack_keep_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(pack(word_tokens(spark, sf_dir), WORD_LENGTH, keep_tail=True))


def pack_no_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(pack(word_tokens(spark, sf_dir), WORD_LENGTH, wrap=False))


def pack_bytes_eod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(pack(byte_tokens(spark, sf_dir), BYTE_LENGTH))


def pack_cut_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of ``pack_bytes_eod`` from documents cut into pieces of 4,096 characters."""
    docs = assign_shard(with_scan_position(table(spark, sf_dir, "documents")), SHARDS)
    pieces = cut_texts(docs.select("shard", "pos", "text"), PIECE_CHARS, words=False)
    tokens = stage(tokenize(pieces, byte_tokenizer(), eod=EOD), "piece-tokens")
    return printed(pack(tokens, BYTE_LENGTH, piece_col=PIECE_COL))


def _cut_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = assign_shard(with_scan_position(table(spark, sf_dir, "documents")), SHARDS)
    pieces = cut_texts(docs.select("shard", "pos", "text"), PIECE_CHARS)
    return stage(tokenize(pieces, word_hash_tokenizer(), before=[BOS], after=[EOS]), "piece-tokens")


def pack_cut_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of ``pack_words_bos_eos`` from pieces that end where words do."""
    return printed(pack(_cut_word_tokens(spark, sf_dir), WORD_LENGTH, piece_col=PIECE_COL))


def pack_cut_no_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of ``pack_no_wrap`` from pieces: a document is cut by a sample's end, not its pieces."""
    return printed(pack(_cut_word_tokens(spark, sf_dir), WORD_LENGTH, wrap=False, piece_col=PIECE_COL))


def tokenize_cut_byte_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of pieces, put together again: those of the whole documents."""
    tokenizer = byte_level_tokenizer(spark, *byte_level_vocab())
    pieces = cut_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_CHARS)
    tokens = tokenize(pieces, tokenizer, eod=tokenizer.eos_id)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(PIECE_COL, "tokens"))), lambda p: p["tokens"]))
    return tokens.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), fingerprint(joined).alias("fingerprint"))


def tokenize_bpe_unspaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without spaces: every document is one word, the longest of tens of thousands of bytes."""
    tokenizer = bpe_tokenizer(spark, small_vocab(), MERGES, to_symbols=hex_bytes)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", " \t\r\n", "").alias("text"))
    tokens = tokenize(docs, tokenizer)
    return tokens.select("doc_id", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint"))


def pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = byte_tokens(spark, sf_dir)
    return pack_report(tokens, pack(tokens, BYTE_LENGTH))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is one document: its turns in order, then one end-of-document id.

    The turns stay rows of their own (no conversation is gathered); the last one gets the id.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).withColumn("ends", F.lit(True))
    place = with_position(turns.select("conv_id", "turn"), ["conv_id", "turn"]).join(last, ["conv_id", "turn"], "left")
    placed = assign_shard(turns.join(place, ["conv_id", "turn"]), SHARDS, pos="conv_id")
    tokens = tokenize(placed, word_hash_tokenizer())
    closed = F.when(F.col("ends"), F.concat("tokens", F.array(F.lit(EOS)))).otherwise(F.col("tokens"))
    return printed(pack(stage(tokens.select("shard", "pos", closed.alias("tokens")), "turn-tokens"), WORD_LENGTH))


def pack_pages_one_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as one stream, framed by the byte ids of a begin and an end text."""
    tokenizer = byte_tokenizer()
    before, after = separators(spark, tokenizer, bos_text=BOS_TEXT, eos_text=EOS_TEXT)
    pages = with_scan_position(table(spark, sf_dir, "pages")).withColumn("shard", F.lit(0).cast("long"))
    tokens = tokenize(pages.select("shard", "pos", "html"), tokenizer, "html", before, after)
    return printed(pack(stage(tokens, "page-tokens"), BYTE_LENGTH))


def no_concat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_samples(table(spark, sf_dir, "documents"))


def byte_range_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = byte_tokenizer(EOD)
    return token_range_audit(
        tokenize(table(spark, sf_dir, "documents").select("text"), tokenizer, eod=EOD), tokenizer.vocab_size
    )


def document_text_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audit(table(spark, sf_dir, "documents"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))


QUERIES = {
    "tokenize_bytes": tokenize_bytes,
    "tokenize_bytes_stats": tokenize_bytes_stats,
    "tokenize_pages_bytes": tokenize_pages_bytes,
    "tokenize_bpe": tokenize_bpe,
    "tokenize_byte_level": tokenize_byte_level,
    "tokenize_code_points": tokenize_code_points,
    "preprocess_lines": preprocess_lines,
    "word_counts": word_counts,
    "pack_words_bos_eos": pack_words_bos_eos,
    "pack_keep_tail": pack_keep_tail,
    "pack_no_wrap": pack_no_wrap,
    "pack_bytes_eod": pack_bytes_eod,
    "pack_cut_bytes": pack_cut_bytes,
    "pack_cut_words": pack_cut_words,
    "pack_cut_no_wrap": pack_cut_no_wrap,
    "tokenize_cut_byte_level": tokenize_cut_byte_level,
    "tokenize_bpe_unspaced": tokenize_bpe_unspaced,
    "pack_stats": pack_stats,
    "pack_conversations": pack_conversations,
    "pack_pages_one_stream": pack_pages_one_stream,
    "no_concat_text": no_concat_text,
    "token_range_audit": byte_range_audit,
    "text_audit": document_text_audit,
}

_WORDS = r"list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '')"
_WORD_IDS = f"list_transform({_WORDS}, lambda w: cast('0x' || substr(md5(w), 1, 7) as bigint))"
_WORD_DOCS = f"""
    {NUMBERED},
    docs as (
        select pos % {SHARDS} as shard, pos,
            list_concat([cast({BOS} as bigint)], {_WORD_IDS}, [cast({EOS} as bigint)]) as ids
        from numbered)"""


def _bytes_of(text: str) -> str:
    """SQL: list of the UTF-8 bytes of a text as numbers."""
    return (
        f"list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda h: cast('0x' || h as bigint))"
    )


_BYTE_DOCS = f"""
    {NUMBERED},
    docs as (
        select pos % {SHARDS} as shard, pos,
            list_concat({_bytes_of('text')}, [cast({EOD} as bigint)]) as ids
        from numbered)"""


def _samples(length: int) -> str:
    """SQL: cut the shards of ``docs(shard, pos, ids)`` into samples."""
    return f"""
    flat as (
        select shard, pos, unnest(ids) as id, generate_subscripts(ids, 1) as i from docs),
    placed as (
        select shard, id, row_number() over (partition by shard order by pos, i) - 1 as k from flat),
    samples as (
        select shard, cast(k // {length} as bigint) as seq, count(*) as n_tokens,
            md5(string_agg(cast(id as varchar), ',' order by k)) as fingerprint
        from placed group by 1, 2)"""


_SHOWN = "select shard, seq, cast(n_tokens as integer) as n_tokens, fingerprint from samples"


# The words of a byte-level encoder.  White space is taken sign by sign, which makes no difference
# here, as no merge joins two of them.
_BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_BYTE_LEVEL_WORDS = "regexp_extract_all(text, '" + _BYTE_LEVEL_PATTERN.replace("'", "''") + "')"


def _merged_symbols(merges: list[tuple[str, str]] = MERGES) -> str:
    """SQL: an encoder's symbols of one word, as hex codes in angle brackets."""
    sql = "regexp_replace(hex(encode(w)), '(..)', '<\\1>', 'g')"
    sql = f"lower({sql})"
    for left, right in merges:
        sql = f"replace({sql}, '<{left}><{right}>', '<{left}{right}>')"
    return sql


def _symbol_id(symbol: str, merges: list[tuple[str, str]] = MERGES) -> str:
    merged = " ".join(f"when '{a}{b}' then {256 + rank}" for rank, (a, b) in enumerate(merges))
    return f"case {symbol} {merged} else cast('0x' || {symbol} as bigint) end"


ORACLES = {
    "tokenize_bytes": f"""
        select doc_id, octet_length(encode(text)) as n_tokens,
            md5(array_to_string({_bytes_of('text')}, ',')) as fingerprint
        from documents""",
    "tokenize_bytes_stats": """
        select lang, count(*) as n_rows, cast(sum(octet_length(encode(text))) as bigint) as n_tokens,
            max(octet_length(encode(text))) as longest
        from documents group by 1""",
    "tokenize_pages_bytes": f"""
        select page_id, octet_length(encode(html)) + 1 as n_tokens,
            md5(array_to_string(list_concat({_bytes_of('html')}, [{EOD}]), ',')) as fingerprint
        from pages""",
    "tokenize_bpe": f"""
        with w as (select doc_id, unnest({_WORDS}) as w, generate_subscripts({_WORDS}, 1) as i from documents),
        spelled as (select doc_id, i, string_split(trim({_merged_symbols()}, '<>'), '><') as symbols from w),
        flat as (select doc_id, i, unnest(symbols) as s, generate_subscripts(symbols, 1) as j from spelled)
        select doc_id, count(*) as n_tokens,
            md5(string_agg(cast({_symbol_id('s')} as varchar), ',' order by i, j)) as fingerprint
        from flat group by 1""",
    "tokenize_byte_level": f"""
        with w as (
            select doc_id, unnest({_BYTE_LEVEL_WORDS}) as w, generate_subscripts({_BYTE_LEVEL_WORDS}, 1) as i
            from documents),
        spelled as (
            select doc_id, i, string_split(trim({_merged_symbols(BYTE_LEVEL_MERGES)}, '<>'), '><') as symbols from w),
        flat as (select doc_id, i, unnest(symbols) as s, generate_subscripts(symbols, 1) as j from spelled),
        ids as (select doc_id, i, j, {_symbol_id('s', BYTE_LEVEL_MERGES)} as id from flat
            union all select doc_id, null, null, {256 + len(BYTE_LEVEL_MERGES)} from documents)
        select doc_id, count(*) as n_tokens,
            md5(string_agg(cast(id as varchar), ',' order by i nulls last, j)) as fingerprint
        from ids group by 1""",
    "tokenize_code_points": """
        select doc_id, length(text) as n_tokens,
            md5(array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)), ','))
                as fingerprint
        from documents""",
    "preprocess_lines": """
        select doc_id, len(string_split(text, chr(10))) as n_lines from documents""",
    "word_counts": f"select doc_id, cast(len({_WORDS}) as bigint) as n_words from documents",
    "pack_words_bos_eos": f"with {_WORD_DOCS}, {_samples(WORD_LENGTH)} {_SHOWN} where n_tokens = {WORD_LENGTH}",
    "pack_keep_tail": f"with {_WORD_DOCS}, {_samples(WORD_LENGTH)} {_SHOWN}",
    "pack_no_wrap": f"""
        with recursive {_WORD_DOCS},
        ranked as (
            select *, len(ids) as n, row_number() over (partition by shard order by pos) - 1 as k from docs),
        fill(shard, k, n, seq, lo) as (
            select shard, k, n, cast(0 as bigint), cast(0 as bigint) from ranked where k = 0
            union all
            select d.shard, d.k, d.n,
                case when f.lo + f.n >= {WORD_LENGTH} then f.seq + 1 else f.seq end,
                case when f.lo + f.n >= {WORD_LENGTH} then 0 else f.lo + f.n end
            from fill f join ranked d on d.shard = f.shard and d.k = f.k + 1),
        kept as (
            select r.shard, f.seq, f.lo, r.ids[1:least(r.n, {WORD_LENGTH} - f.lo)] as ids
            from ranked r join fill f using (shard, k)),
        flat as (select shard, seq, lo, unnest(ids) as id, generate_subscripts(ids, 1) as i from kept)
        select shard, seq, cast(count(*) as integer) as n_tokens,
            md5(string_agg(cast(id as varchar), ',' order by lo, i)) as fingerprint
        from flat group by 1, 2 having count(*) = {WORD_LENGTH}""",
    "pack_bytes_eod": f"with {_BYTE_DOCS}, {_samples(BYTE_LENGTH)} {_SHOWN} where n_tokens = {BYTE_LENGTH}",
    "pack_stats": f"""
        with {NUMBERED},
        shards as (
            select pos % {SHARDS} as shard, cast(sum(octet_length(encode(text)) + 1) as bigint) as n_tokens
            from numbered group by 1)
        select shard, n_tokens // {BYTE_LENGTH} as n_samples,
            n_tokens // {BYTE_LENGTH} * {BYTE_LENGTH} as n_packed, n_tokens,
            n_tokens % {BYTE_LENGTH} as n_left_over
        from shards""",
    "pack_conversations": f"""
        with marked as (
            select *, turn = max(turn) over (partition by conv_id) as ends from conversations),
        docs as (
            select conv_id % {SHARDS} as shard, row_number() over (order by conv_id, turn) as pos,
                case when ends then list_concat({_WORD_IDS}, [cast({EOS} as bigint)]) else {_WORD_IDS} end as ids
            from marked),
        {_samples(WORD_LENGTH)} {_SHOWN} where n_tokens = {WORD_LENGTH}""",
    "pack_pages_one_stream": f"""
        with docs as (
            select cast(0 as bigint) as shard, row_number() over (order by page_id) as pos,
                {_bytes_of(f"'{BOS_TEXT}' || html || chr(10)")} as ids
            from pages),
        {_samples(BYTE_LENGTH)} {_SHOWN} where n_tokens = {BYTE_LENGTH}""",
    "no_concat_text": "select text from documents",
    "token_range_audit": f"""
        with ids as (
            select unnest(list_concat({_bytes_of('text')}, [cast({EOD} as bigint)])) as id from documents)
        select cast(min(id) as integer) as min_id, cast(max(id) as integer) as max_id,
            cast(ceil(257 / 128.0) * 128 as bigint) as padded_vocab,
            min(id) >= 0 and max(id) < ceil(257 / 128.0) * 128 as fits
        from ids""",
    "text_audit": """
        select count(*) as n_documents, count(*) filter (where text is null) as n_null,
            count(*) filter (where text = '') as n_empty
        from documents""",
}

# Cutting documents into pieces changes no sample and no id.
ORACLES |= {
    "pack_cut_bytes": ORACLES["pack_bytes_eod"],
    "pack_cut_words": ORACLES["pack_words_bos_eos"],
    "pack_cut_no_wrap": ORACLES["pack_no_wrap"],
    "tokenize_cut_byte_level": ORACLES["tokenize_byte_level"],
    "tokenize_bpe_unspaced": f"""
        with w as (select doc_id, regexp_replace(text, '[ \t\r\n]', '', 'g') as w from documents),
        spelled as (
            select doc_id, case when w = '' then [] else string_split(trim({_merged_symbols()}, '<>'), '><') end as symbols
            from w)
        select doc_id, cast(len(symbols) as bigint) as n_tokens,
            md5(array_to_string(list_transform(symbols, lambda s: {_symbol_id('s')}), ',')) as fingerprint
        from spelled""",
}
