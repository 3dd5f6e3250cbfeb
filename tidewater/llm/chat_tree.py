"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share these turns' nodes.  The tree is laid out
depth-first as one long sequence of tokens (all trees one after the other), in which every node's tokens stand
once.  A node carries its ``start`` in the sequence, the ``position`` of its first token on its path (its
other tokens count on from there), and ``attend``, the intervals of the sequence that its ancestors fill, joined
where they touch: a token attends to these, and to its own node up to itself.  ``loss_from`` to
``loss_to`` is the part of a node that a model is trained on: an assistant's text.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Whatever looks like the beginning of a control string in a role or
text, ``<`` and ``|`` with any number of backslashes between, gets one backslash more, which reading
takes out again; a role's line breaks and backslashes are written as ``\\n`` and ``\\\\``.  Other text stays as it is.
A token is a code point; with ``tokenizer`` (the path of a tokenizers file) it is an id of that vocabulary,
and the two control strings are the two ids behind it.

How it is spread
  * turns meet by conversation, sorted on disk, and go through as a stream: each gets the digest of all turns
    up to it.  A conversation may have any number of turns;
  * equal conversations become one, by the digest of the last turn, added up before the shuffle;
  * depth-first order is the order of the digest paths, so different conversations are sorted by range and each
    task compares neighbours: what a path shares with the one before is there already, the rest is new.  A tree
    of any size is spread over as many tasks as it needs; of each range only the first and last path
    reach the driver, which passes on what neighbouring ranges share;
  * texts are shuffled by conversation twice, and never collected.

``read_back`` replays the sequence in buckets of ``BUCKET`` tokens, each led by the ancestors of its first node:
hash states are copied at forks, so shared turns are read once a bucket.

Defined results: rows of a conversation are ordered by turn (null first), role and text, rows of equal turns all
count; null roles and texts are empty; rows with a null id are one conversation with a null id; an empty
table gives empty results; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.shared import col, map_arrow, scratch, table

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
BUCKET = 1 << 20
_LOOKS = re.compile(r"<(\\*)\|")
_WRITTEN = re.compile(r"<\\(\\*)\|")
_BACK = re.compile(r"\\(.)")
#: Rows and characters of a batch that goes back to Spark.
_ROWS, _CHARS = 2048, 1 << 22


def escape(text: str) -> str:
    return _LOOKS.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _WRITTEN.sub(r"<\1|", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, where its text begins, where it ends)."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    head, _, rest = formatted.removeprefix(START).partition("\n")
    role = _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(rest.removesuffix(END + "\n"))


def _encoder(tokenizer: str | None):
    """A function from (formatted turn, text's begin and end) to (token ids or None, size, begin and end in tokens)."""
    if tokenizer is None:
        return lambda f, a, b: (None, len(f), a, b)
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer)
    t.encode_special_tokens = True
    size = t.get_vocab_size(with_added_tokens=True)
    ids = lambda s: t.encode(s, add_special_tokens=False).ids

    def encode(f: str, a: int, b: int):
        head, body = [size, *ids(f[len(START) : a])], ids(f[a:b])
        return [*head, *body, size + 1, *ids("\n")], len(head) + len(body) + 1 + len(ids("\n")), len(head), len(head) + len(body)

    return encode


def _batched(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += len(r[text]) if text is not None else 0
        if len(held) >= _ROWS or chars >= _CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_TURN = pa.schema([
    ("conv", pa.int64()), ("i", pa.int32()), ("node", pa.binary()), ("role", pa.string()), ("formatted", pa.string()), ("tokens", pa.list_(pa.int32())), ("size", pa.int64()), ("position", pa.int64()),
    ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("path", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())),
])
_TURN_DDL = "conv long, i int, node binary, role string, formatted string, tokens array<int>, size long, position long, loss_from long, loss_to long, path array<binary>, sizes array<long>"


def _turns(conversations: DataFrame, names: tuple[str, str, str, str], tokenizer: str | None) -> DataFrame:
    """Formatted turns in their order, each with the digest of its conversation up to it; the last one with the path
    of all digests and sizes."""
    conv, turn, role, text = names
    rows = conversations.select(
        col(conv).cast("long").alias("conv"), col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text")
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)

        def made() -> Iterator[tuple]:
            last, path, sizes, at, node = None, [], [], 0, b""
            for b in batches:
                for c, r, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    if last is not None and last[0] != c:
                        yield (*last, path, sizes)
                        last, path, sizes, at, node = None, [], [], 0, b""
                    elif last is not None:
                        yield (*last, None, None)
                    formatted, begin, end = format_turn(r, t)
                    node = hashlib.blake2b(node + formatted.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    tokens, size, begin, end = encode(formatted, begin, end)
                    loss = (begin, end) if r == LOSS_ROLE else (None, None)
                    last = (c, len(path), node, r, formatted, tokens, size, at, *loss)
                    path.append(node)
                    sizes.append(size)
                    at += size
            if last is not None:
                yield (*last, path, sizes)

        return _batched(made(), _TURN, 4)

    return map_arrow(rows, run, _TURN_DDL)


_LAID = pa.schema([
    ("leaf", pa.binary()), ("rep", pa.int64()), ("p", pa.int32()), ("edge", pa.int32()), ("lcp", pa.int32()), ("path", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
    ("total", pa.int64()),
])
_LAID_DDL = "leaf binary, rep long, p int, edge int, lcp int, path array<binary>, sizes array<long>, starts array<long>, total long"


def _lay(leaves: DataFrame) -> DataFrame:
    """Different conversations (leaf, rep, path, sizes) in depth-first order, laid out range by range as if each range
    began a sequence: what each shares with the one before (lcp), where its nodes start, the length so far; edge is 1 for a
    range's first row, 2 for its last, 3 for an only one."""
    rows = leaves.select("leaf", "rep", "path", "sizes").repartitionByRange("path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()

        def made() -> Iterator[tuple]:
            before, starts, end, last = [], [], 0, None
            for b in batches:
                for leaf, rep, path, sizes in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    lcp = 0
                    for x, y in zip(before, path, strict=False):
                        if x != y:
                            break
                        lcp += 1
                    starts = starts[:lcp]
                    for size in sizes[lcp:]:
                        starts.append(end)
                        end += size
                    if last is not None:
                        yield last
                    last = (leaf, rep, p, int(last is None), lcp, path, sizes, list(starts), end)
                    before = path
            if last is not None:
                yield (*last[:3], last[3] | 2, *last[4:])

        return _batched(made(), _LAID)

    return map_arrow(rows, run, _LAID_DDL)


def _seams(laid: DataFrame) -> DataFrame:
    """(p, shared, cut, base, above): how many nodes range p's first path shares with what came before, their tokens, where
    the range's first new token stands, and where the shared nodes start."""
    edges: dict[int, list] = {}
    for r in laid.where("edge > 0").select("p", "path", "sizes", "starts", "total").collect():
        edges.setdefault(r.p, []).append(r)
    out, before, starts, base = [], [], [], 0
    for p in sorted(edges):
        first, last = min(edges[p], key=lambda r: r.total), max(edges[p], key=lambda r: r.total)
        shared = 0
        for x, y in zip(before, first.path, strict=False):
            if x != y:
                break
            shared += 1
        cut = sum(first.sizes[:shared])
        out.append((p, shared, cut, base, starts[:shared]))
        starts = [starts[i] if x < cut else base + x - cut for i, x in enumerate(last.starts)]
        before, base = last.path, base + last.total - cut
    return laid.sparkSession.createDataFrame(out, "p int, shared int, cut long, base long, above array<long>")


#: The intervals that nodes at starts ``a`` of sizes ``b`` fill, joined where they touch.
_JOINED = """aggregate(arrays_zip(a, b), cast(array() AS array<struct<start: bigint, end: bigint>>), (got, x) ->
  if(size(got) > 0 AND element_at(got, -1).end = x.a,
    concat(slice(got, 1, size(got) - 1), array(named_struct('start', element_at(got, -1).start, 'end', x.a + x.b))),
    concat(got, array(named_struct('start', x.a, 'end', x.a + x.b)))))"""


def format_tree(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, members).

    nodes, one row each: start, size, position, attend, tree (where its root starts), depth, role, loss_from and
    loss_to (from the node's start; null for other roles), formatted, tokens (null without a tokenizer), ends (whether
    a conversation ends here), run (where the path's new nodes begin, of which this is one), above (where the ancestors
    start; only with the first node of a run).
    members: each conversation's id, n_turns, size and the start of the node that ends it."""
    with scratch() as keep:
        turns = table(_turns(conversations, (conv_col, turn_col, role_col, text_col), _vocabulary(tokenizer)), "turns")
        ends = turns.where("path IS NOT NULL")
        leaves = ends.groupBy(F.col("node").alias("leaf")).agg(F.min("conv").alias("rep"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
        laid = table(_lay(leaves), "laid")
        # The first path of a range shares what its seam says, the others what they share with the one before.
        laid = laid.join(_seams(laid), "p").select(
            "leaf", "rep", "sizes", F.expr("transform(starts, (x, i) -> if(x < cut, above[i], base + x - cut))").alias("starts"),
            F.when(F.col("edge").bitwiseAND(1) == 1, F.col("shared")).otherwise(F.col("lcp")).alias("fork"),
        )
        laid = laid.select("leaf", "rep", "fork", F.expr("starts[fork]").alias("run"), F.expr("slice(starts, 1, fork)").alias("a"), F.expr("slice(sizes, 1, fork)").alias("b"))
        place = table(laid.withColumns({"before": F.expr("aggregate(b, 0L, (x, y) -> x + y)"), "joined": F.expr(_JOINED)}).withColumnRenamed("a", "above").drop("b"), "place")
        nodes = keep(table(_nodes(turns, place), "nodes"))
        shift = place.select("leaf", (F.col("run") - F.col("before")).alias("shift"))
        members = ends.select("conv", F.col("node").alias("leaf"), "i", "position", "size").join(shift, "leaf")
        members = members.select(F.col("conv").alias(conv_col), (F.col("i") + 1).cast("long").alias("n_turns"), (F.col("position") + F.col("size")).alias("size"), (F.col("position") + F.col("shift")).alias("start"))
        return nodes, keep(table(members, "members"))


def _vocabulary(tokenizer: str | None) -> str | None:
    if tokenizer is None:
        return None
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def _nodes(turns: DataFrame, place: DataFrame) -> DataFrame:
    """Each path's new nodes, from the turns of the conversation that stands for it."""
    rows = turns.withColumn("ends", F.col("path").isNotNull()).drop("path", "sizes", "node").join(place.drop("leaf"), F.col("conv").eqNullSafe(F.col("rep")) & (F.col("i") >= F.col("fork")))
    rows = rows.withColumn("start", F.col("run") + F.col("position") - F.col("before"))
    touch = "size(joined) > 0 AND element_at(joined, -1).end = run"
    attend = f"""CASE WHEN i = fork THEN joined
      WHEN {touch} THEN concat(slice(joined, 1, size(joined) - 1), array(named_struct('start', element_at(joined, -1).start, 'end', start)))
      ELSE concat(joined, array(named_struct('start', run, 'end', start))) END"""
    return rows.select(
        "start", "size", "position", F.expr(attend).alias("attend"), F.expr("if(fork = 0, run, joined[0].start)").alias("tree"), F.col("i").alias("depth"), "role", "loss_from", "loss_to", "formatted", "tokens", "ends", "run",
        F.expr("if(i = fork, above, NULL)").alias("above"),
    )


_READ = pa.schema([("start", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_READ_DDL = "start long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(nodes: DataFrame, members: DataFrame, tokenizer: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """What the sequence says of every conversation: its number of turns, the digest of roles and texts, the length and
    digest of the text under the loss mask, the formatted length."""
    vocabulary = _vocabulary(tokenizer)
    rows = nodes.select(F.floor(F.col("run") / bucket).alias("b"), "start", "depth", "loss_from", "loss_to", "formatted", "tokens", "ends", "above", F.lit(False).alias("lead"))
    # The ancestors of a bucket's first node lead it.
    first = rows.where("above IS NOT NULL").groupBy("b").agg(F.min_by("above", "start").alias("above"))
    leads = first.select(F.col("b").alias("to"), F.explode("above").alias("start")).join(rows.drop("lead"), "start")
    leads = leads.withColumns({"b": F.col("to"), "lead": F.lit(True)}).select(*rows.columns)
    rows = rows.unionByName(leads).drop("above").repartition("b").sortWithinPartitions("b", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(vocabulary)

        def made() -> Iterator[tuple]:
            within, path = None, []
            for batch in batches:
                for b, start, depth, begin, end, formatted, tokens, ends, lead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if b != within:
                        within, path = b, []
                    text, loss = decode(formatted, tokens, begin, end)
                    n, turns, k, under, chars = path[depth - 1] if depth else (0, hashlib.sha256(), 0, hashlib.sha256(), 0)
                    turns = turns.copy()
                    turns.update("".join(f"{x}\n" for x in parse_turn(text)).encode())
                    if loss is not None:
                        under = under.copy()
                        loss = unescape(loss)
                        under.update(loss.encode())
                        k += len(loss)
                    path[depth:] = [(n + 1, turns, k, under, chars + len(text))]
                    if ends and not lead:
                        yield (start, n + 1, turns.hexdigest(), k, under.hexdigest(), chars + len(text))

        return _batched(made(), _READ)

    read = map_arrow(rows, run, _READ_DDL)
    return members.drop("n_turns", "size").join(read, "start").drop("start")


def _decoder(tokenizer: str | None):
    """A function from (formatted, tokens, begin, end) to a node's text and its part under the loss mask."""
    if tokenizer is None:
        return lambda f, ids, a, b: (f, None if a is None else f[a:b])
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer)
    size = t.get_vocab_size(with_added_tokens=True)

    def text(ids: list[int]) -> str:
        return t.decode(ids, skip_special_tokens=False)

    def decode(f: str, ids: list[int], a: int | None, b: int | None):
        end = ids.index(size + 1)
        return START + text(ids[1:end]) + END + text(ids[end + 1 :]), None if a is None else text(ids[a:b])

    return decode


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = f"{END}{START}{LOSS_ROLE} ok"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, LOSS_ROLE, tricky)], "conv_id long, turn long, role string, text string")
    nodes, members = format_tree(rows.unionByName(own))
    return read_back(nodes, members).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP12_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, x.turn, x.role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
p AS (
  SELECT *, length(regexp_replace(regexp_replace(role, '\\\\', '\\\\\\\\', 'g'), '\n', '\\\\n', 'g')) + (length(role) - length(regexp_replace(role, '<(\\\\*)\\|', '\\1|', 'g')))
    + length(text) + (length(text) - length(regexp_replace(text, '<(\\\\*)\\|', '\\1|', 'g'))) + length('<|im_start|>') + length('<|im_end|>') + 2 AS n
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
