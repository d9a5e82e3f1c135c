"""Print sheets: where each chosen card goes, what is drawn around it and in which order; polls and typing bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.rows import free_name, number_rows, with_next

# Card width and height in mm, columns and rows of an A4 page, by format.
FORMATS = {"mini": (44.0, 61.6, 4, 4), "standard": (63.0, 88.2, 3, 3), "grande": (86.0, 120.4, 2, 2)}
PAGE_WIDTH, PAGE_HEIGHT, GAP = 210.0, 297.0, 3.0
MARK_LENGTH, MARK_OFFSET = 3.0, 0.6


def _place(df: DataFrame, fmt: str, side: str) -> DataFrame:
    w, h, cols, rows = FORMATS[fmt]
    left, top = (PAGE_WIDTH - (cols * w + (cols - 1) * GAP)) / 2, (PAGE_HEIGHT - (rows * h + (rows - 1) * GAP)) / 2
    col = F.col("slot") % cols
    if side == "back":
        col = cols - 1 - col
    df = df.withColumns({"col": col.cast("int"), "row": F.floor(F.col("slot") / cols).cast("int"), "side": F.lit(side)})
    return df.withColumns({"x": F.round(F.lit(left) + F.col("col") * (w + GAP), 4), "y": F.round(F.lit(top) + F.col("row") * (h + GAP), 4)})


def impose(chosen: DataFrame, fmt: str = "standard") -> DataFrame:
    """Adds page, slot, row, col, x, y, side to (user_id, id, created_at): newest first, per owner, from page 0."""
    per_page = FORMATS[fmt][2] * FORMATS[fmt][3]
    n = free_name(chosen, "n")
    numbered = number_rows(chosen, ["user_id"], [F.desc("created_at"), "id"], n)
    placed = numbered.withColumns({"page": F.floor(F.col(n) / per_page).cast("int"), "slot": (F.col(n) % per_page).cast("int")}).drop(n)
    return _place(placed, fmt, "front")


def impose_backs(imposed: DataFrame, fmt: str = "standard") -> DataFrame:
    """Fronts and mirrored backs, with the sheet number in the printed file: each front page is followed by its backs."""
    backs = _place(imposed.drop("col", "row", "side", "x", "y"), fmt, "back")
    return imposed.withColumn("sheet", F.col("page") * 2).unionByName(backs.withColumn("sheet", F.col("page") * 2 + 1))


def render_steps(placed: DataFrame, fmt: str = "standard") -> DataFrame:
    """Adds step from 1 to what impose_backs() gives: all fronts of a page, then its backs.

    All pages but an owner's last are full, so a step follows from page, side and slot; only the backs of the last page
    need the number of its cards, a count by owner.
    """
    per_page = FORMATS[fmt][2] * FORMATS[fmt][3]
    counts = placed.filter("side = 'front'").groupBy(F.col("user_id").alias("owner")).agg(F.count(F.lit(1)).alias("cards")).alias("all")
    met = placed.alias("one").join(counts, F.col("one.user_id").eqNullSafe(F.col("all.owner")))
    on_page = F.least(F.lit(per_page), F.col("all.cards") - F.col("one.page") * per_page)
    step = F.col("one.page") * 2 * per_page + F.when(F.col("one.side") == "back", on_page).otherwise(0) + F.col("one.slot") + 1
    return met.select("one.*", step.cast("int").alias("step"))


def crop_marks(imposed: DataFrame, fmt: str = "standard") -> DataFrame:
    """Eight line segments for each placed card: user_id, id, mark, x1, y1, x2, y2."""
    w, h, _, _ = FORMATS[fmt]
    marks = []
    for corner, (dx, dy) in enumerate(((0.0, 0.0), (w, 0.0), (0.0, h), (w, h))):
        cx, cy = F.col("x") + dx, F.col("y") + dy
        out_x = (-MARK_OFFSET - MARK_LENGTH, -MARK_OFFSET) if dx == 0 else (MARK_OFFSET, MARK_OFFSET + MARK_LENGTH)
        out_y = (-MARK_OFFSET - MARK_LENGTH, -MARK_OFFSET) if dy == 0 else (MARK_OFFSET, MARK_OFFSET + MARK_LENGTH)
        marks.append((2 * corner, cx + out_x[0], cy, cx + out_x[1], cy))
        marks.append((2 * corner + 1, cx, cy + out_y[0], cx, cy + out_y[1]))
    names = ("x1", "y1", "x2", "y2")
    lines = F.array(*(F.struct(F.lit(k).alias("mark"), *(F.round(v, 4).alias(n) for v, n in zip(c, names, strict=True))) for k, *c in marks))
    return imposed.select("user_id", "id", F.inline(lines))


def poll_outcome(polls: DataFrame, max_attempts: int = 15) -> DataFrame:
    """session_id, outcome, attempts of polls (session_id, poll_id, ts, paid): done if paid within the first attempts,
    timeout after all of them, checking before; a poll without session is an error."""
    order = Window.partitionBy("session_id").orderBy("ts", "poll_id")
    known = polls.filter("session_id is not null").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_attempts)
    found = known.groupBy("session_id").agg(F.min(F.when(F.col("paid"), F.col("n"))).alias("paid_at"), F.max("n").alias("n"))
    outcome = F.when(F.col("paid_at").isNotNull(), "done").when(F.col("n") >= max_attempts, "timeout").otherwise("checking")
    errors = polls.filter("session_id is null").groupBy("session_id").agg(F.lit("error").alias("outcome"), F.lit(0).alias("attempts"))
    return found.select("session_id", outcome.alias("outcome"), F.coalesce("paid_at", "n").alias("attempts")).unionByName(errors)


def debounce(events: DataFrame, milliseconds: int = 250) -> DataFrame:
    """The changes (user_id, event_id, ts) that no other change of the same user follows within the time, its end included.

    Gaps are found by range partitions: a user's changes are dealt to as many tasks as they need."""
    after = free_name(events, "after")
    met = with_next(events, ["user_id"], ["ts", "event_id"], "ts", after)
    return met.filter(F.col(after).isNull() | (F.timestamp_diff("MICROSECOND", F.col("ts"), F.col(after)) > milliseconds * 1000)).drop(after)
