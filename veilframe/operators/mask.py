"""Reversible masking: numbered placeholders per session, issued in reading order, and the way back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.placeholders import (
    append_instruction,
    escape_html,
    find_placeholders,
    format_placeholder,
    parse_placeholder,
    strip_instruction,
)
from veilframe.functions.spans import let, rewrite
from veilframe.plans.staging import (
    BROADCAST_BYTES,
    BROADCAST_PER_SESSION,
    block_offsets,
    in_blocks,
    lookup,
    repeatable,
    settled,
    stage,
    with_file_place,
)

UNKNOWN_SESSION = "unknown"
PLACE_BYTES = 256  # of a row's file and position
VAULT_SCHEMA = "session_id string, seq bigint, original string, placeholder string, type string"


@dataclass(frozen=True)
class Masked:
    """Result of :func:`mask`. Write ``entries`` to the vault before publishing ``rows``."""

    rows: DataFrame
    entries: DataFrame


def literal_numbers(text: Column) -> Column:
    """Type and number of each placeholder-like token already in a text."""
    return F.filter(
        F.transform(find_placeholders(text), lambda s: parse_placeholder(s["match"])),
        lambda p: p.isNotNull() & p["num"].isNotNull())


def _fits_broadcast(table: DataFrame, session: str, width: Column) -> bool:
    per_session = table.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b"))
    size = per_session.agg(F.max("n").alias("n"), F.sum("b").alias("b")).first()
    return (size["n"] or 0) <= BROADCAST_PER_SESSION and (size["b"] or 0) <= BROADCAST_BYTES


def _session_maps(table: DataFrame, session: str, key: str, value: str, name: str) -> DataFrame:
    return table.groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def _sized(table: DataFrame, session: str, key: str, value: str, small: bool | None) -> bool:
    """Whether to broadcast: never without a measured size; ``small=False`` rules it out."""
    return small is not False and _fits_broadcast(table, session, F.length(key) + F.length(value) + 32)


def _known_session(session: str) -> Column:
    return F.coalesce(F.col(session).cast("string"), F.lit(UNKNOWN_SESSION))


def counters_of(vault: DataFrame) -> DataFrame:
    """``session_id, type, issued, last`` of a vault: the highest number and place of each session and type."""
    token = parse_placeholder(F.col("placeholder"))
    return vault.groupBy("session_id", token["type"].alias("type")).agg(
        F.max(token["num"]).alias("issued"), F.max("seq").alias("last"))


def new_entries(occurrences: DataFrame, literals: DataFrame, order: list[str], vault: DataFrame | None,
                style: str, counters: DataFrame | None = None) -> DataFrame:
    """Vault entries for values seen for the first time, numbered as a reader would: by document, then position.

    ``occurrences``: session_id, __row, order columns, start, type, value. ``literals``: session_id, __row, type, num.
    ``__row`` names the document; ``order`` columns may be null (first) or tie (by row). A number continues the
    session's highest one of its type and skips numbers of placeholder-like tokens in the document that adds the entry.
    With ``rn0`` entries of the type added by earlier documents and ``k`` the place within the document, it is
    ``rn0 + k + max(vault, running max(literal - rn0))``. The vault's numbers are read from its ``counters`` if given.
    """
    if vault is not None and counters is None:
        counters = counters_of(vault)
    order = [*order, "__row"]
    firsts = occurrences.groupBy("session_id", F.col("value").alias("original")).agg(
        F.min(F.struct(*order, "start", "type")).alias("first"))
    if vault is not None:
        firsts = firsts.join(vault.select("session_id", "original"), ["session_id", "original"], "left_anti")
    fresh = stage(firsts.select("session_id", "original", "first.*"))

    doc = ["session_id", "__row"]
    sorting = ["session_id", *order]
    added = fresh.groupBy(*sorting, "type").agg(F.count(F.lit(1)).alias("added"))
    pasted = literals.groupBy(*doc, "type").agg(F.max("num").alias("literal"))
    blocks = in_blocks(
        added.join(pasted, [*doc, "type"], "left").withColumn("literal", F.coalesce("literal", F.lit(0))), sorting)

    kind = ["session_id", "type"]
    local = Window.partitionBy(*kind, "block").orderBy(*order)
    ranked = blocks.join(block_offsets(blocks, kind, F.col("added")), [*kind, "block"]).withColumn(
        "rn0", F.col("offset") + F.coalesce(
            F.sum("added").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("lift", F.max(F.col("literal") - F.col("rn0")).over(
        local.rowsBetween(Window.unboundedPreceding, 0)))
    by_block = Window.partitionBy(*kind).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranked.groupBy(*kind, "block").agg(F.max("lift").alias("lift")).select(
        *kind, "block", F.coalesce(F.max("lift").over(by_block), F.lit(0)).alias("carried"))
    if counters is not None:
        carried = carried.join(counters.select(*kind, "issued"), kind, "left").withColumn(
            "carried", F.greatest("carried", F.coalesce("issued", F.lit(0)))).drop("issued")
    numbers = ranked.join(carried, [*kind, "block"]).select(
        *doc, "type", (F.col("rn0") + F.greatest("carried", "lift", F.lit(0))).alias("base"))

    # Entry order of a session: earlier documents, then position within the document.
    seen = Window.partitionBy("session_id", "block").orderBy(*order)
    per_doc = blocks.groupBy(*sorting, "block").agg(F.sum("added").alias("added"))
    places = per_doc.join(block_offsets(per_doc, ["session_id"], F.col("added")), ["session_id", "block"]).select(
        *doc, (F.col("offset") + F.sum("added").over(seen) - F.col("added")).alias("seq0"))
    if counters is not None:
        last = counters.groupBy("session_id").agg(F.max("last").alias("last"))
        places = places.join(last, "session_id", "left").withColumn(
            "seq0", F.col("seq0") + F.coalesce("last", F.lit(0))).drop("last")

    within = Window.partitionBy(*doc).orderBy("start")
    entries = fresh.withColumns({
        "k": F.row_number().over(Window.partitionBy(*doc, "type").orderBy("start")),
        "place": F.row_number().over(within),
    }).join(numbers, [*doc, "type"]).join(places, doc)
    return stage(entries.select(
        "session_id", (F.col("seq0") + F.col("place")).alias("seq"), "original",
        format_placeholder(F.col("type"), F.col("base") + F.col("k"), style).alias("placeholder"), "type"))


def _split(scanned: DataFrame, more: dict[str, Column], detections: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with detections, with the ``more`` columns; rows without any; rows that were not scanned. The scan runs once.

    Rows of files are told apart by file and position: only those with detections are written down, and the others are
    read from their files again, without a scan. Behind other sources, and where further columns come from the scan, all
    rows are written down.
    """
    hit = F.size(detections) > 0
    placed, others = with_file_place(scanned), [c for c in scanned.columns if c != detections]
    if placed is None or not settled(placed.select(*others)):
        base = stage(scanned.withColumns(more).withColumn("__dirty", F.coalesce(hit, F.lit(False))), partition_by="__dirty")
        known = F.col(detections).isNotNull()
        rest = base.filter("not __dirty")
        return base.filter("__dirty"), rest.filter(known), rest.filter(~known)
    kept = stage(placed.withColumns(more).filter(F.coalesce(hit, F.lit(True))))
    place = kept.select("__file", "__place")
    if kept.count() * PLACE_BYTES <= BROADCAST_BYTES:
        place = F.broadcast(place)
    none = F.array().cast(scanned.schema[detections].dataType)
    clean = placed.select(*others, "__file", "__place").join(place, ["__file", "__place"], "left_anti")
    return kept.filter(hit), clean.select(*others, none.alias(detections)), kept.filter(F.col(detections).isNull())


def mask(scanned: DataFrame, session: str, order: list[str], vault: DataFrame | None = None, text_col: str = "text",
         style: str = "square", detections: str = "detections", out: str = "masked",
         small_vault: bool | None = None, counters: DataFrame | None = None) -> Masked:
    """Replace every detection by its session's placeholder; one value has one placeholder per session.

    ``order`` is the order of arrival; ties are settled by the place in the input, nulls come first. A null session is
    the session ``unknown``. A text whose detections are null was not scanned: its masked text is null. A detection
    without a placeholder is an error, never published. The scan runs once. Only texts with detections are written to the
    shared folder (all of them where :func:`_split` says so) and take part in joins, by a row number of their own; the
    files of the input must not change until the result is written. A vault of measured small size is joined by broadcast, a larger one by value; both give the same rows.
    ``small_vault=False`` rules the broadcast out. ``counters`` are the vault's, if they are kept beside it.
    """
    if session in order:
        raise ValueError("the session is not part of the order within the session")
    columns = list(scanned.columns)
    ordered = [f"__o{i}" for i in range(len(order))]
    dirty, clean, unscanned = _split(scanned, {
        "__literals": F.when(F.size(detections) > 0, literal_numbers(F.col(text_col))),
        "__row": F.monotonically_increasing_id(),
        "__session": _known_session(session),
        **{o: F.col(c) for o, c in zip(ordered, order)},
    }, detections)
    doc = [F.col("__session").alias("session_id"), "__row"]

    hits = dirty.select(*doc, *ordered, F.posexplode(detections).alias("__i", "d")).select(
        "session_id", "__row", *ordered, "__i", F.col("d.start").alias("start"), F.col("d.type").alias("type"),
        F.col("d.value").alias("value"))
    literals = dirty.select(*doc, F.explode("__literals").alias("p")).select("session_id", "__row", "p.type", "p.num")
    entries = new_entries(hits, literals, ordered, vault, style, counters)

    known = entries
    if vault is not None:
        # Only the stored entries this input needs, found by session and value so that no session is one big key.
        wanted = hits.select("session_id", F.col("value").alias("original")).distinct()
        known = entries.unionByName(
            vault.select(*entries.columns).join(wanted, ["session_id", "original"], "left_semi"))
    # A value stored twice keeps its first placeholder.
    tokens = known.groupBy(F.col("session_id").alias("__session"), F.col("original").alias("value")).agg(
        F.min_by("placeholder", F.struct("seq", "placeholder")).alias("placeholder"))
    if _sized(tokens, "__session", "value", "placeholder", small_vault):
        maps = stage(_session_maps(tokens, "__session", "value", "placeholder", "__map"))
        rows = dirty.join(F.broadcast(maps), "__session", "left").withColumn("__new", F.transform(
            detections, lambda d: F.try_element_at("__map", d["value"])))
    else:
        found = lookup(hits.select(F.col("session_id").alias("__session"), "__row", "__i", "value"), tokens,
                       ["__session", "value"])
        per_doc = found.groupBy("__row").agg(
            F.array_sort(F.collect_list(F.struct("__i", "placeholder"))).alias("__pairs"))
        rows = dirty.join(per_doc, "__row", "left").withColumn(
            "__new", F.transform("__pairs", lambda p: p["placeholder"]))
    missing = F.raise_error(F.lit("a detection has no placeholder")).cast("string")
    masked = rows.withColumn(out, let(F.col("__new"), lambda new: rewrite(
        F.col(text_col), F.col(detections), lambda d, i: F.coalesce(F.get(new, i), missing))))
    kept = [*columns, out]
    rows = masked.select(*kept).unionByName(clean.withColumn(out, F.col(text_col)).select(*kept)).unionByName(
        unscanned.withColumn(out, F.lit(None).cast("string")).select(*kept))
    return Masked(rows, entries)


def restore(df: DataFrame, vault: DataFrame, session: str, key: list[str] | None = None, text_col: str = "masked",
            out: str = "restored", missing: str = "missing", strip: bool = False,
            small_vault: bool | None = None) -> DataFrame:
    """Put the originals back. Unknown placeholders, as from another session, stay and are listed once each in
    ``missing``, last in the text first; so does a placeholder that the vault gives to several originals. A null session
    is the session ``unknown``. ``strip`` removes the instruction sentence first. Rows are told apart by a number of
    their own; ``key`` is accepted for older callers and not used.
    """
    text = strip_instruction(F.col(text_col)) if strip else F.col(text_col)
    columns = list(df.columns)
    work = df.withColumn("__text", text).withColumn("__tokens", find_placeholders(F.col("__text")))
    named = F.coalesce(F.size("__tokens") > 0, F.lit(False))
    more = {"__row": F.monotonically_increasing_id(), "__session": _known_session(session)}
    if repeatable(df):  # only texts with tokens are written down; the others are read again
        dirty, clean = stage(work.filter(named).withColumns(more)), work.filter(~named)
    else:
        base = stage(work.withColumns({"__dirty": named, **more}), partition_by="__dirty")
        dirty, clean = base.filter("__dirty"), base.filter("not __dirty")
    tokens = dirty.select("__session", "__row", F.posexplode("__tokens").alias("__i", "s")).select(
        "__session", "__row", "__i", F.col("s.match").alias("token"))
    # Only the entries that these texts name.
    entries = vault.select(
        F.col("session_id").alias("__session"), F.col("placeholder").alias("token"), "original").join(
        tokens.select("__session", "token").distinct(), ["__session", "token"], "left_semi").groupBy(
        "__session", "token").agg(F.when(F.min("original") == F.max("original"), F.min("original")).alias("original"))
    entries = stage(entries.filter("original IS NOT NULL"))

    if _sized(entries, "__session", "token", "original", small_vault):
        maps = _session_maps(entries, "__session", "token", "original", "__map")
        rows = dirty.join(F.broadcast(maps), "__session", "left").withColumn("__old", F.transform(
            "__tokens", lambda s: F.try_element_at("__map", s["match"])))
    else:
        found = lookup(tokens, entries, ["__session", "token"])
        per_doc = found.groupBy("__row").agg(
            F.array_sort(F.collect_list(F.struct("__i", "original"))).alias("__pairs"))
        rows = dirty.join(per_doc, "__row", "left").withColumn(
            "__old", F.transform("__pairs", lambda p: p["original"]))
    unknown = F.filter(
        F.zip_with("__tokens", "__old", lambda s, o: F.when(o.isNull(), s["match"])), lambda t: t.isNotNull())
    restored = rows.withColumns({
        out: let(F.col("__old"), lambda old: rewrite(
            F.col("__text"), F.col("__tokens"), lambda s, i: F.coalesce(F.get(old, i), s["match"]))),
        missing: F.array_distinct(F.reverse(unknown)),
    })
    kept = [*columns, out, missing]
    untouched = clean.withColumns({out: F.col("__text"), missing: F.array().cast("array<string>")})
    return restored.select(*kept).unionByName(untouched.select(*kept))


def with_instruction(df: DataFrame, text_col: str = "masked", out: str | None = None) -> DataFrame:
    return df.withColumn(out or text_col, append_instruction(F.col(text_col)))


def highlight(text: Column, detections: Column) -> Column:
    """HTML preview: every piece escaped, detections wrapped in ``<span class="highlight">``."""
    return rewrite(text, detections, lambda d, i: F.concat(
        F.lit('<span class="highlight">'), escape_html(d["value"]), F.lit("</span>")), gap=escape_html)
