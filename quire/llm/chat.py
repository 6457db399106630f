"""Chat formatting after collapsing cumulative snapshots.

A log often holds a conversation again and again, each time with a few turns more. Each turn's content is hashed
with its place, and the running sums of these hashes identify each prefix of a conversation. Equal conversations
keep the smallest id; an anti-join drops those that are a proper prefix of another; the turns of the rest are
rendered, one row each, so no conversation ever has to be a single value.

Running sums and places go over blocks of `SEGMENT` turn numbers, and then over blocks: a conversation that holds a
large share of the log is spread over many tasks. Many rows of a few turns are too: such a block is summed by turn, and
by parts of a turn by their hash, first. Only hashes go through all that; texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

SEGMENT = 256
#: Rows of a segment from which on its turns, and parts of a turn, are counted on their own.
CROWDED = 4096
#: Hexadecimal digits of the hash of role and text by which rows of one turn are dealt to parts.
PART = 2
#: Four sums of 32-bit hashes stand for a prefix.
LANES = ("l0", "l1", "l2", "l3")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Whose turns a model learns from.
TRAINED = ("assistant",)


def identified(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, tie (a hash of role and text), and at and unnumbered, which are the turn without null."""
    role = F.coalesce(F.concat(F.length("role").cast("string"), F.lit(":"), "role"), F.lit("-"))
    tie = F.md5(F.concat(role, F.coalesce(F.concat(F.lit("+"), "text"), F.lit("-"))).cast("binary"))
    return rows.select(
        "conv_id", "turn", "role", "text", tie.alias("tie"), F.coalesce("turn", F.lit(0)).alias("at"), F.col("turn").isNull().alias("unnumbered")
    )


#: What tells the rows of a conversation apart.
SPOT = ["conv_id", "at", "unnumbered", "tie"]


def _sums_before(spots: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """spots with, for each name, the sum over its conversation's earlier spots (before_) and over them all (all_).

    spots (conv_id, block, cell_turn, cell_part, turn, tie and names) are summed in cells, cells in blocks, blocks in
    conversations. No task gets more than a cell's spots, a block's cells or a conversation's blocks.
    """
    cell, block = ["conv_id", "block", "cell_turn", "cell_part"], Window.partitionBy("conv_id", "block")
    first, none = lambda *x: [F.col(y).asc_nulls_first() for y in x], F.lit(0).cast("long")
    earlier = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), none)
    cells = spots.groupBy(*cell).agg(*(F.sum(x).alias(x) for x in names))
    blocks = cells.groupBy("conv_id", "block").agg(*(F.sum(x).alias(x) for x in names))
    whole, over = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy(*first("block"))
    bases = blocks.select("conv_id", "block", *(earlier(over, x).alias(f"base_{x}") for x in names), *(F.sum(x).over(whole).alias(f"all_{x}") for x in names))
    offsets = cells.select(*cell, *(earlier(block.orderBy(*first("cell_turn", "cell_part")), x).alias(f"in_{x}") for x in names))
    placed = _join(offsets, bases, ["conv_id", "block"]).select(
        *cell, *(f"all_{x}" for x in names), *((F.col(f"in_{x}") + F.col(f"base_{x}")).alias(f"from_{x}") for x in names)
    )
    own = Window.partitionBy(*cell).orderBy(*first("turn", "tie"))
    ranked = spots.select("*", *(earlier(own, x).alias(f"own_{x}") for x in names))
    return _join(ranked, placed, cell).select(
        *spots.columns, *(f"all_{x}" for x in names), *((F.col(f"own_{x}") + F.col(f"from_{x}")).alias(f"before_{x}") for x in names)
    )


def _lanes(n: Column) -> list[Column]:
    low, halves = F.lit(0xFFFFFFFF), (F.xxhash64(n, "tie"), F.xxhash64("tie", n))
    found = [x for h in halves for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(low))]
    return [x.alias(lane) for x, lane in zip(found, LANES, strict=True)]


def prefixes(spots: DataFrame) -> DataFrame:
    """conv_id, n (turns of the prefix), the lanes, and n_turns (of the whole conversation), for each spot.

    spots: conv_id (not null), turn, tie, each once.
    """
    one = F.lit(1).cast("long").alias("one")
    keyed = spots.select("conv_id", "turn", "tie", F.floor(F.col("turn") / SEGMENT).alias("block"), one)
    crowded = keyed.groupBy("conv_id", "block").agg(F.count("*").alias("rows")).filter(F.col("rows") > CROWDED)
    # A block is one cell, but for those that hold very many rows.
    keyed = _join(keyed, crowded, ["conv_id", "block"], "left").withColumns({
        "cell_turn": F.when(F.col("rows").isNotNull(), F.col("turn")), "cell_part": F.when(F.col("rows").isNotNull(), F.substring("tie", 1, PART)),
    }).drop("rows")
    n = F.col("before_one") + 1
    counted = _sums_before(keyed, ("one",)).select(*keyed.columns, n.alias("n"), F.col("all_one").alias("n_turns"), *_lanes(n))
    summed = _sums_before(counted.drop("one"), LANES)
    return summed.select("conv_id", "n", "n_turns", *((F.col(f"before_{x}") + F.col(x)).alias(x) for x in LANES))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equal keys, null equal to null."""
    other = right.select(*(F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, same, how).drop(*(f"__{k}" for k in keys))


def formatted(rows: DataFrame) -> DataFrame:
    """One row for each distinct turn of each maximal conversation: conv_id, n_turns, turn, role, trained, rendered.

    rows: conv_id, turn, role, text. Turns go by turn (null first), then by a hash of role and text where they
    tie; a row that repeats another counts once. Of equal conversations the one of the smallest id stays. A row
    without conv_id is a conversation of one turn; of equal ones the smallest turn stays, and none that another
    conversation begins with. A null role is `unknown`, a null text empty. No rows give no rows; other columns are
    not read.
    """
    own = identified(rows)
    named = own.filter("conv_id IS NOT NULL")
    spots = stored(named.select(*SPOT, "turn").dropDuplicates(SPOT), "spots")
    found = stored(prefixes(spots), "prefixes")
    key = ["n", *LANES]
    whole = found.filter("n = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    proper = found.filter("n < n_turns").select(*key).distinct()
    maximal = whole.join(proper, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"))
    kept = spots.join(maximal, "conv_id").select(*SPOT, "n_turns")
    # Texts are shuffled once, repeated rows no more than once from each task.
    turns = named.dropDuplicates(SPOT).join(kept, SPOT)
    one = F.lit(1).cast("long")
    alone = own.filter("conv_id IS NULL").groupBy("role", "text", "tie").agg(F.min("turn").alias("turn"))
    alone = alone.select("role", "text", "turn", *_lanes(one)).join(found.filter("n = 1").select(*LANES).distinct(), list(LANES), "left_anti")
    columns = ["conv_id", "n_turns", "turn", "role", "text"]
    every = turns.select(columns).union(alone.select(F.lit(None).cast(rows.schema["conv_id"].dataType), one, "turn", "role", "text"))
    return every.select(
        "conv_id", "n_turns", "turn", "role",
        F.coalesce(F.col("role").isin(*TRAINED), F.lit(False)).alias("trained"),
        rendered(F.col("role"), F.col("text")).alias("rendered"),
    )


def rendered(role: Column, text: Column) -> Column:
    """A turn in chat markup; markup within a text is taken apart so that it ends no turn."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("<| im_start |>")), F.lit(CLOSE), F.lit("<| im_end |>"))
    clean_role = F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[\s<|>]+", "_")
    return F.concat(F.lit(OPEN), clean_role, F.lit("\n"), safe, F.lit(CLOSE + "\n"))
