"""A trie of the turns that conversations begin with, by ROLLUP over positional columns.

Conversations are first rebuilt so that they share beginnings, see ``rebuild``. A turn's id is a 128-bit hash of its role and text. Rows
of ``WIDTH`` positional columns hold a conversation's ids, one row for each block of positions, keyed by the node that the blocks
before lead to; ``GROUP BY key, ROLLUP(t1, ..., t8)`` then aggregates the prefixes of all lengths of all blocks together, and
``grouping_id`` tells a column that is rolled up from one past a conversation's end. The key of a node is two 64-bit XORs of hashes of its
(position, turn id) pairs, so a block knows its predecessor's node without waiting for it, however long a conversation is.

Sums over subtrees come from the same ROLLUP, without a walk. The smallest member of a node owns it, and what a conversation owns is the
rest of its path from some depth on. A leaf counts once, for its owner, so the leaves below a node are a sum over members. Of a member's
turns those before what it owns are saved; with ``before`` the code points above a node, which its members share, the tokens saved below
it are the sum of (own start - before) over its members but the owner.

Member ids at a node are hashed from a sorted stream, so that a group of copies of any size needs no memory.

A null role or text is empty; rows without a conv_id belong to no conversation and make none; null turns come first; turns of one number are
in the order of their ids; an empty table gives an empty one; other columns are left out. Two different turns, or nodes, among 10^9
get one id with a chance under 10^-19.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, read_table
from .digests import EMPTY, joined_sha256

WIDTH = 8
SHARED = 5  # the most turns that a conversation takes from another
_NAMES = [f"t{i + 1}" for i in range(WIDTH)]
_SIZES = [f"c{i + 1}" for i in range(WIDTH)]
_KEYS = ["kx", "ky"]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, id, chars) of each turn, counted from 1."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    told = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"), F.length(text).cast("long").alias("chars"),
    )
    rows = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    return told.select("conv_id", F.row_number().over(rows).cast("long").alias("pos"), "id", "chars")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with shared beginnings: their turns (conv_id, pos, id, chars), and (conv_id) of all, turnless ones too.

    Conversation c begins with the first h turns of the conversation c - c % 100, where h is crc32(c) % 6, in place of its own first h.
    """
    known = materialize(numbered(turns), "turns")
    firsts = F.collect_list(F.when(F.col("pos") <= SHARED, F.struct("pos", "id", "chars")))
    convs = known.groupBy("conv_id").agg(F.array_sort(firsts).alias("firsts"))
    asked = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int").alias("h"))
    begun = asked.join(convs.withColumnRenamed("conv_id", "base"), "base", "left").select("conv_id", "h", F.slice(F.coalesce("firsts", F.array().cast("array<struct<pos:bigint,id:binary,chars:bigint>>")), F.lit(1), F.col("h")).alias("head"))
    heads = begun.select("conv_id", F.explode("head").alias("e")).select("conv_id", "e.pos", "e.id", "e.chars")
    own = known.join(begun.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "id", "chars")
    rebuilt = materialize(heads.unionByName(own), "rebuilt")
    ids = materialize(convs.select("conv_id"), "ids")
    discard(known)
    return rebuilt, ids


def _place(pos: Column, turn: Column) -> list[Column]:
    """Two hashes of a turn at its position."""
    return [F.xxhash64(F.lit(seed), pos, turn) for seed in (17, 43)]


def blocks(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, block, kx, ky, before, t1.., c1.., size, total, ex, ey): a row for each block of a conversation's positions.

    ``kx, ky`` is the node that the blocks before lead to, ``before`` their code points, ``size, total, ex, ey`` the whole conversation's turns,
    code points and node.
    """
    at = (F.col("pos") - 1) % WIDTH
    hx, hy = _place(F.col("pos"), F.col("id"))
    rows = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / WIDTH).alias("block")).agg(
        *(F.max(F.when(at == i, F.col("id"))).alias(t) for i, t in enumerate(_NAMES)), *(F.max(F.when(at == i, F.col("chars"))).alias(c) for i, c in enumerate(_SIZES)),
        F.bit_xor(hx).alias("hx"), F.bit_xor(hy).alias("hy"), F.count("*").alias("n"),
    )
    # turnless conversations have a block without ids
    rows = ids.join(rows, "conv_id", "left").withColumns({"block": F.coalesce("block", F.lit(0).cast("long")), "hx": F.coalesce("hx", F.lit(0).cast("long")), "hy": F.coalesce("hy", F.lit(0).cast("long")), "n": F.coalesce("n", F.lit(0).cast("long"))})
    chars = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0).cast("long")) for c in _SIZES))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    rows = rows.withColumn("chars", chars)
    return rows.select(
        "conv_id", "block", *(F.coalesce(F.bit_xor(h).over(earlier), none).alias(k) for h, k in (("hx", "kx"), ("hy", "ky"))), F.coalesce(F.sum("chars").over(earlier), none).alias("before"), *_NAMES, *_SIZES,
        "hx", "hy", "n", "chars",
    )


def ends(rows: DataFrame) -> DataFrame:
    """(conv_id, size, total, kx, ky): where each conversation ends."""
    return rows.groupBy("conv_id").agg(F.sum("n").alias("size"), F.sum("chars").alias("total"), F.bit_xor("hx").alias("kx"), F.bit_xor("hy").alias("ky"))


def nodes(rows: DataFrame) -> DataFrame:
    """The trie's nodes, from block rows with ``size``, ``start`` (code points before what a conversation owns) and ``leaf``.

    (kx, ky, px, py, depth, conv_id, n_convs, longest, chars, before, n_leaves, saved_tokens): ``kx, ky`` a node's key, ``px, py`` its parent's.
    """
    # the common key and the columns rolled up: level j keeps t1..tj, and grouping_id has a bit for each of the others
    grouped = rows.sparkSession.sql(
        f"""
        SELECT block, kx, ky, before, {", ".join(_NAMES)}, {WIDTH} - bit_count(grouping_id()) AS level,
          min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS longest, {", ".join(f"max({c}) AS {c}" for c in _SIZES)},
          sum(leaf) AS n_leaves, sum(start) AS starts, min_by(start, conv_id) AS own_start
        FROM {{rows}} GROUP BY block, kx, ky, before, ROLLUP({", ".join(_NAMES)})""",
        rows=rows,
    )
    level, ids, sizes = F.col("level"), F.array(*_NAMES), F.array(*_SIZES)
    first = F.col("block") * WIDTH

    def key(prior: str, which: int, upto: Column) -> Column:
        parts = (F.when(upto >= i + 1, _place(first + i + 1, F.col(t))[which]).otherwise(F.lit(0).cast("long")) for i, t in enumerate(_NAMES))
        return reduce(lambda a, b: a.bitwiseXOR(b), parts, F.col(prior))

    # past its end a conversation has no id; a later block's level 0 is the node that ends the block before
    real = grouped.where(F.when(level == 0, F.col("block") == 0).otherwise(F.get(ids, level - 1).isNotNull()))
    above = F.col("before") + F.aggregate(F.slice(sizes, F.lit(1), F.greatest(level - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    told = real.select(
        *(key(k, i, level).alias(k) for i, k in enumerate(_KEYS)), *(F.when((level > 0) | (F.col("block") > 0), key(k, i, level - 1)).alias(p) for i, (k, p) in enumerate(zip(_KEYS, ("px", "py"), strict=True))),
        (first + level).alias("depth"), "conv_id", "n_convs", "longest", F.when(level > 0, F.get(sizes, level - 1)).otherwise(0).alias("chars"), above.alias("before"), "n_leaves", "starts", "own_start",
    )
    return told.withColumn("saved_tokens", F.col("starts") - F.col("own_start") - (F.col("n_convs") - 1) * F.col("before"))


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialize(blocks(turns, ids), "blocks")
    last = materialize(ends(rows), "ends")
    nothing = F.lit(0).cast("long")
    sized = rows.join(last.select("conv_id", "size", "total"), "conv_id")
    owned = nodes(sized.withColumns({"start": nothing, "leaf": nothing})).groupBy("conv_id").agg(
        F.min_by("before", "depth").alias("start"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"),
    )
    owned = materialize(owned, "owned")
    # a conversation that owns nothing repeats another one whole
    known = sized.join(owned, "conv_id", "left").withColumns({"start": F.coalesce("start", "total"), "leaf": F.coalesce("leaf", nothing)})
    found = materialize(nodes(known), "nodes")
    children = found.where("depth > 0").groupBy(F.col("px").alias("kx"), F.col("py").alias("ky"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    parents = found.select(F.col("kx").alias("px"), F.col("ky").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    # ids of a thousand come together first, so a group of copies has few rows
    spans = last.groupBy(*_KEYS, F.col("size").alias("depth"), F.floor(F.col("conv_id") / 1024).alias("span")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("members")
    )
    digests = joined_sha256(spans, [*_KEYS, "depth"], ["span"], "members", ",", "ends_sha256")
    told = found.join(children, [*_KEYS, "depth"], "left").join(digests, [*_KEYS, "depth"], "left").join(parents, ["px", "py", "depth"], "left")
    out = materialize(
        told.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", nothing).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")),
        "trie",
    )
    for spent in (rows, last, owned, found):
        discard(spent)
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns, ids = rebuild(read_table(spark, sf_dir, "conversations"))
    out = trie(turns, ids)
    discard(turns)
    discard(ids)
    return out


#: The same rows in SQL: paths as text, subtrees by their beginnings.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos, id, chars
  FROM (SELECT *, md5(length(role) || ':' || role || text) AS id, length(text) AS chars FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
asked AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295]::BIGINT[] || list_transform(range(8 * length(s)), lambda i: ((ascii(s[(i // 8 + 1)::INT]) >> (i % 8)::INT) & 1)::BIGINT),
    lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM turns)),
parts AS (
  SELECT a.conv_id, 0 AS part, pos, id, chars FROM asked a JOIN turns t ON t.conv_id = a.base AND pos <= h
  UNION ALL SELECT a.conv_id, 1, pos, id, chars FROM asked a JOIN turns t ON t.conv_id = a.conv_id AND pos > h),
whole AS (SELECT a.conv_id, coalesce(ids, []) AS ids, coalesce(sizes, []) AS sizes FROM asked a LEFT JOIN (SELECT conv_id, list(id ORDER BY part, pos) AS ids, list(chars ORDER BY part, pos) AS sizes FROM parts GROUP BY 1) p ON p.conv_id = a.conv_id),
steps AS (SELECT conv_id, d, array_to_string(ids[:d::INT], '') AS path, coalesce(sizes[d::INT], 0) AS chars, len(ids) = d AS ends FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM whole)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS digest FROM steps GROUP BY 1, 2),
kids AS (SELECT left(path, 32 * (d - 1)::INT) AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids ON kids.path = n.path),
below AS (SELECT a.path, count(*) FILTER (b.k = 0) AS n_leaves, sum((b.n - 1) * b.chars)::BIGINT AS saved_tokens FROM told a JOIN told b ON starts_with(b.path, a.path) GROUP BY 1)
SELECT t.conv_id, t.d AS depth, p.conv_id AS parent_conv_id, t.n AS n_convs, t.k AS n_children, n_leaves, saved_tokens, t.digest AS ends_sha256
FROM told t JOIN below b ON b.path = t.path LEFT JOIN nodes p ON t.d > 0 AND p.d = t.d - 1 AND p.path = left(t.path, 32 * (t.d - 1)::INT)
"""
