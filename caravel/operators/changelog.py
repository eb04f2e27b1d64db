"""Changelog algebra: ordered create, read, update and delete events to one row per key, runs, and the state they make.

Events carry op (c, r, u, d), a position that orders them within a key, and for each value column whether the event sets it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(events: DataFrame, keys: list[str], values: list[str], op: str = "op", pos: str = "pos", version: str = "version", masks: dict[str, Column] | None = None, presence: bool = False, check: bool = False) -> DataFrame:
    """(keys, op, values, version, pos): the net effect of each key's events, with one shuffle and map-side combining.

    A create or read sets all columns, so the last event that sets a column is never older than the last create: the value is that of the
    greatest position among the events that set it. The result's op is d after a last delete, else the last create's or read's, else u.
    Values are wrapped in a struct, since null is a value too. presence adds `included`, an array of booleans that says which values the net
    effect sets: apply_to_state() and runs() read it. check stops the job at an event that breaks the contract (see errors()).
    """
    masks = masks or {}
    if check:
        events = checked(events, keys, op, pos, version)
    c, p = F.col(op), F.col(pos)
    sets = lambda v: c.isin("c", "r") | ((c == "u") & F.coalesce(masks.get(v, F.lit(True)), F.lit(False)))
    out = events.groupBy(*keys).agg(
        F.max_by(c, p).alias("_last"), F.max_by(F.when(c.isin("c", "r"), c), F.when(c.isin("c", "r"), p)).alias("_made"), F.max_by(version, p).alias("_version"), F.max(p).alias("_pos"),
        *[F.max_by(F.when(sets(v), F.struct(F.col(v).alias("v"))), F.when(sets(v), p)).alias(f"_v_{v}") for v in values],
    )
    gone = F.col("_last") == "d"
    included = [F.array(*[~gone & F.col(f"_v_{v}").isNotNull() for v in values]).alias("included")] if presence else []
    return out.select(*keys, F.when(gone, F.lit("d")).otherwise(F.coalesce("_made", F.lit("u"))).alias(op), *[F.when(~gone, F.col(f"_v_{v}.v")).alias(v) for v in values], F.col("_version").alias(version), F.col("_pos").alias(pos), *included)


def _reasons(keys: list[str], op: str, pos: str, version: str, mask: str | None, width: int | None, full: bool) -> Column:
    before = F.lag(op).over(Window.partitionBy(*keys).orderBy(pos))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    reason = (
        F.when(F.col(op).isNull() | ~F.col(op).isin("c", "r", "u", "d"), "unknown operation")
        .when(null_key, "null key")
        .when(F.col(version).isNull() | (F.col(version) < 0), "bad version")
        .when((F.col(op) == "u") & (before == "d"), "update after delete")
    )
    if mask is not None:
        reason = reason.when(~F.coalesce(mask_fits(F.col(mask), width), F.lit(False)), "bad mask").when(F.col(op).isin("c", "r") & ~all_set(F.col(mask), width), "a create sets all columns")
        if full:
            reason = reason.when((F.col(op) == "u") & ~all_set(F.col(mask), width), "an update sets all columns")
    return reason


def errors(events: DataFrame, keys: list[str], op: str = "op", pos: str = "pos", version: str = "version", mask: str | None = None, width: int | None = None, full: bool = False) -> DataFrame:
    """Events that break the contract, with a reason: unknown op, null key, null or negative version, update straight after a delete, a mask of
    another length or with bits beyond `width`, a create (with full: an update too) that does not set all columns."""
    return events.withColumn("reason", _reasons(keys, op, pos, version, mask, width, full)).where("reason is not null")


def checked(events: DataFrame, keys: list[str], op: str = "op", pos: str = "pos", version: str = "version", mask: str | None = None, width: int | None = None, full: bool = False) -> DataFrame:
    """The events; the first that breaks the contract stops the job."""
    reason = _reasons(keys, op, pos, version, mask, width, full)
    return events.withColumn("_reason", reason).withColumn(op, F.when(F.col("_reason").isNull(), F.col(op)).otherwise(F.raise_error(F.col("_reason")))).drop("_reason")


def _octet(mask: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(mask, i + 1, 1)), 16, 10).cast("int")


def bit(mask: Column, i: int) -> Column:
    """Whether bit i of a binary mask is set: the least bit of each byte is its first."""
    return _octet(mask, i // 8).bitwiseAND(F.lit(1 << (i % 8))) != 0


def mask_fits(mask: Column, width: int) -> Column:
    """Exactly as many bytes as `width` columns need, and no bit beyond them."""
    size = (width + 7) // 8
    fits = F.octet_length(mask) == size
    return fits & (_octet(mask, size - 1).bitwiseAND(F.lit(0xFF << (width % 8) & 0xFF)) == 0) if width % 8 else fits


def all_set(mask: Column, width: int) -> Column:
    full = bytes([0xFF] * (width // 8) + ([(1 << width % 8) - 1] if width % 8 else []))
    return F.hex(mask) == full.hex().upper()


def old_keys(events: DataFrame, keys: list[str], olds: list[str], old_values: list[str] | None = None, op: str = "op") -> DataFrame:
    """Events re-keyed for collapse(): a delete's key is its old one where that is given, and an update without a move has none.

    Old keys and old values exclude each other. An update or a delete must carry its old key, a create or a read must not.
    """
    if olds and old_values:
        raise ValueError("old keys and old values exclude each other")
    given = F.lit(False)
    for o in olds:
        given = given | F.col(o).isNotNull()
    reason = F.when(F.col(op).isin("c", "r") & given, "a create has no old key").when(F.col(op).isin("u", "d") & ~given, "an old key is missing")
    out = events.withColumn(op, F.when(reason.isNull(), F.col(op)).otherwise(F.raise_error(reason)))
    return out.withColumns({k: F.when(F.col(op) == "d", F.col(o)).otherwise(F.col(k)) for k, o in zip(keys, olds, strict=True)})


def full_image_upserts(events: DataFrame, keys: list[str], olds: list[str], op: str = "op", mask: str | None = None, width: int | None = None) -> DataFrame:
    """The policy that a complete update of one key is a create; an update that moves the key or leaves columns out stops the job."""
    moved = F.lit(False)
    for k, o in zip(keys, olds, strict=True):
        moved = moved | (F.col(o).isNotNull() & ~F.col(o).eqNullSafe(F.col(k)))
    partial = ~all_set(F.col(mask), width) if mask else F.lit(False)
    reason = F.when(moved, "an update moves the key").when(partial, "an update leaves columns out")
    return events.withColumn(op, F.when(F.col(op) != "u", F.col(op)).when(reason.isNull(), F.lit("c")).otherwise(F.raise_error(reason)))


def split_key_moves(events: DataFrame, key: str | list[str], old_key: str | list[str], op: str = "op", pos: str = "pos", mask: str | None = None, width: int | None = None) -> DataFrame:
    """An update that moves the key is a delete of the old one and a create of the new one, at positions 2r and 2r+1; it must set all columns."""
    keys, olds = ([key], [old_key]) if isinstance(key, str) else (list(key), list(old_key))
    moved = F.lit(False)
    for k, o in zip(keys, olds, strict=True):
        moved = moved | (F.col(o).isNotNull() & (F.col(o) != F.col(k)))
    moved = (F.col(op) == "u") & moved
    if mask:
        moved = F.when(moved & ~all_set(F.col(mask), width), F.raise_error(F.lit("a key move sets all columns"))).otherwise(moved)
    one = lambda o, ks, p: F.struct(o.alias("o"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(ks)], p.alias("p"))
    parts = F.when(moved, F.array(one(F.lit("d"), olds, 2 * F.col(pos)), one(F.lit("c"), keys, 2 * F.col(pos) + 1))).otherwise(F.array(one(F.col(op), keys, 2 * F.col(pos) + 1)))
    rest = [c for c in events.columns if c not in (*keys, *olds, op, pos)]
    return events.select(*rest, F.explode(parts).alias("_e")).select(*rest, *[F.col(f"_e.k{i}").alias(k) for i, k in enumerate(keys)], F.col("_e.o").alias(op), F.col("_e.p").alias(pos))


def runs(collapsed: DataFrame, within: list[str], op: str = "op", pos: str = "pos") -> DataFrame:
    """Adds run: numbers maximal stretches of one operation class (c and r are one) and one set of included columns by position, within the given
    columns. `within` bounds what one task sorts: a partition of the source, say."""
    w = Window.partitionBy(*within).orderBy(pos)
    kind = F.when(F.col(op).isin("c", "r"), "upsert").when(F.col(op) == "u", "update").otherwise("delete")
    same = F.lag("op_class").over(w).eqNullSafe(F.col("op_class"))
    if "included" in collapsed.columns:
        same = same & F.lag("included").over(w).eqNullSafe(F.col("included"))
    return collapsed.withColumn("op_class", kind).withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w)).drop("_new")


def _change(collapsed: DataFrame, keys: list[str], values: list[str], op: str) -> DataFrame:
    included = F.col("included") if "included" in collapsed.columns else F.array(*[F.lit(True) for _ in values])
    return collapsed.select(*keys, F.col(op).alias("_op"), included.alias("_in"), *[F.col(v).alias(f"_new_{v}") for v in values])


def apply_to_state(state: DataFrame, collapsed: DataFrame, keys: list[str], values: list[str], op: str = "op") -> DataFrame:
    """Upserts, updates and deletes of collapsed rows on a state with unique keys; one full join on the keys. A value that an update does not
    set stays. Updates of keys that the state lacks are left out: unmatched() counts them, and sinks.merge stops at them."""
    both = state.withColumn("_there", F.lit(True)).join(_change(collapsed, keys, values, op), keys, "full")
    keep = F.col("_op").isNull() | (F.col("_op").isin("c", "r")) | ((F.col("_op") == "u") & F.coalesce("_there", F.lit(False)))
    old = lambda i: F.col("_op").isNull() | ((F.col("_op") == "u") & ~F.get("_in", F.lit(i)))
    return both.where(keep).select(*keys, *[F.when(old(i), F.col(v)).otherwise(F.col(f"_new_{v}")).alias(v) for i, v in enumerate(values)])


def unmatched(state: DataFrame, collapsed: DataFrame, keys: list[str], op: str = "op") -> DataFrame:
    """Updates whose key the state lacks."""
    return collapsed.where(F.col(op) == "u").join(state.select(*keys), keys, "left_anti")


def restore(state: DataFrame, collapsed: DataFrame, keys: list[str], values: list[str], op: str = "op") -> DataFrame:
    """Collapsed rows as full images: what an update leaves out is looked up in the current state. An update without a current row stops the job."""
    current = state.select(*keys, F.struct(*[F.col(v).alias(v) for v in values]).alias("_now"))
    both = collapsed.join(current, keys, "left")
    included = F.col("included") if "included" in collapsed.columns else F.array(*[F.lit(True) for _ in values])
    lost = (F.col(op) == "u") & F.col("_now").isNull() & F.exists(included, lambda x: ~x)
    out = {v: F.when((F.col(op) == "u") & ~F.get(included, F.lit(i)), F.col(f"_now.{v}")).otherwise(F.col(v)) for i, v in enumerate(values)}
    both = both.withColumn(op, F.when(lost, F.raise_error(F.lit("an update has no current row"))).otherwise(F.col(op)))
    return both.select(*keys, op, *[c.alias(v) for v, c in out.items()], *[c for c in collapsed.columns if c not in (*keys, op, *values, "included")])


def stored(df: DataFrame, dropped: tuple[str, ...] = ("op", "pos", "version", "included")) -> DataFrame:
    """What reaches storage: no system, operation or old columns."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in dropped and not c.startswith(("_system_", "_old_"))])
