"""Changes as pure functions from the current table and a delta to the next one.

Parquet tables take no updates, so each change is a plan whose result is written as a new snapshot. All are set-based:
a delta may hold any number of changes, and many changes of one key are folded in their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a reader setting is before anyone sets it.
SETTINGS = {
    "font_family": "system-ui", "font_size": 16, "font_weight": 400, "line_height": 1.6, "letter_spacing": 0.0, "paragraph_spacing": 16, "text_align": "justify", "theme": "light",
    "background_color": "#FFFFFF", "text_color": "#333333", "page_mode": "scroll", "brightness": 100, "margin_horizontal": 20, "margin_vertical": 40,
}
#: Colour of a bookmark that names none.
BOOKMARK_COLOUR = "#FFD700"
SESSION_DAYS = 30


# ---------------------------------------------------------------- inserts


def insert(current: DataFrame, new: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Append rows with ids that follow the largest one.

    Ids are dense and given in the order of `order`: ranges are sorted in parallel, each partition's offset is the sum
    of the counts before it. Only one count per partition reaches the driver.
    """
    order = order or [c for c in new.columns if c != key]
    top = current.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]  # one number
    numbered = dense_rank_rows(new, order, key, int(top))
    return current.unionByName(numbered.select(*(F.col(c).cast(current.schema[c].dataType) for c in current.columns if c in numbered.columns), *(F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns if c not in numbered.columns)))


def dense_rank_rows(df: DataFrame, order: list[str], column: str, start: int = 0) -> DataFrame:
    """Rows with numbers start + 1, start + 2, … in the given order, without a window over the whole table."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    from librarium.session import checkpoint

    ranged = checkpoint(df.drop(column).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # one row per partition
    offsets, total = {}, start
    for p in sorted(counts):
        offsets[p] = total
        total += counts[p]
    if not offsets:
        return ranged.withColumn(column, F.lit(None).cast("bigint")).drop("_p", "_i")
    within = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    base = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("_p"))
    return ranged.withColumn(column, (base + within + 1).cast("bigint")).drop("_p", "_i")


# ---------------------------------------------------------------- updates


def replace_keyed(current: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of the keys in `new` are replaced by those of `new` (delete and insert in one step)."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def partial_update(current: DataFrame, delta: DataFrame, key: str | list[str], columns: list[str], now: Column | None = None, stamp: str = "updated_at") -> DataFrame:
    """Non-null values of the delta overwrite; null never clears a column. Rows that the delta names get `stamp` = now.

    delta has one row per key (see `fold`).
    """
    keys = [key] if isinstance(key, str) else key
    d = delta.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = current.join(d, keys, "left")
    kept = []
    for c in current.columns:
        if c in columns:
            kept.append(F.coalesce(F.col(f"_new_{c}").cast(current.schema[c].dataType), F.col(c)).alias(c))
        elif c == stamp and now is not None:
            kept.append(F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c))
        else:
            kept.append(F.col(c))
    return out.select(*kept)


def fold(events: DataFrame, key: list[str], columns: list[str], order: Column, required: str | None = None) -> DataFrame:
    """Many changes of a key in their order, as one: of each column the last value that is not null.

    One partial aggregation (no window), so a key that a tenth of all events share is combined in every task first.
    Events whose `required` column is null are no valid change and are left out.
    """
    if required:
        events = events.filter(F.col(required).isNotNull())
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    return events.groupBy(*key).agg(*(last(c) for c in columns))


#: Fields of reading progress that keep their value where a change leaves them null.
PROGRESS_KEPT = ["current_page", "total_pages", "cfi_location", "document_id", "device_id"]


def upsert_progress(current: DataFrame | None, events: DataFrame) -> DataFrame:
    """Reading progress by user and book: progress and time are always replaced, the other fields keep what the new event leaves null.

    events: user_id, book_id, progress, ts, event_id and those of PROGRESS_KEPT that the devices send; repeats of an
    event change nothing. Events without progress are no valid change. A new row starts at page 0. The result has the
    columns of `current`, or those of the events where there is no table yet.
    """
    sent = [c for c in PROGRESS_KEPT if c in events.columns]
    fields = ["progress", *sent, "last_read_at"]
    new = fold(events.withColumnRenamed("ts", "last_read_at"), ["user_id", "book_id"], fields, F.struct("last_read_at", "event_id"), "progress")
    page = lambda c: F.coalesce(c, F.lit(0)) if "current_page" in fields else c
    if current is None:
        return new.withColumn("current_page", page(F.col("current_page"))) if "current_page" in sent else new
    kept = [c for c in current.columns if c not in ("user_id", "book_id")]
    old = current.select("user_id", "book_id", *(F.col(c).alias(f"_old_{c}") for c in kept), F.lit(True).alias("_there"))
    joined = old.join(new, ["user_id", "book_id"], "full_outer")

    def value(c: str) -> Column:
        v = F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in fields else F.col(f"_old_{c}")
        if c == "current_page":
            v = F.when(F.col("_there"), v).otherwise(F.coalesce(v, F.lit(0)))
        return v.cast(current.schema[c].dataType).alias(c)

    return joined.select("user_id", "book_id", *(value(c) for c in kept))


def patch_settings(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Settings by user: null fields of the delta keep the old value; users new to the table start from the defaults."""
    old = current.select("user_id", *(F.col(c).alias(f"_old_{c}") for c in SETTINGS))
    joined = old.join(delta, "user_id", "full_outer")
    return joined.select("user_id", *(F.coalesce(F.col(c), F.col(f"_old_{c}"), F.lit(v)).cast(current.schema[c].dataType).alias(c) for c, v in SETTINGS.items()))


def put_settings(current: DataFrame, delta: DataFrame) -> DataFrame:
    """The same with every field sent: a field missing in the delta goes back to its default."""
    full = delta.select("user_id", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in SETTINGS.items()))
    return patch_settings(current, full)


def settings_of(users: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings of every user; users without a row get the defaults."""
    return users.select("user_id").join(settings, "user_id", "left").select("user_id", *(F.coalesce(F.col(c), F.lit(v)).cast(settings.schema[c].dataType).alias(c) for c, v in SETTINGS.items()))


def toggle(df: DataFrame, column: str, keys: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The boolean turned over, for the rows of `keys` or for all."""
    if keys is None:
        return df.withColumn(column, ~F.col(column))
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), ~F.col(column)).otherwise(F.col(column))).drop("_hit").select(df.columns)


def set_priorities(rules: DataFrame, delta: DataFrame) -> DataFrame:
    """New priorities by id; unknown ids are ignored."""
    return partial_update(rules, delta, "id", ["priority"])


def set_status(books: DataFrame, delta: DataFrame) -> DataFrame:
    """delta: id, parse_status. Status only; what was parsed stays."""
    return partial_update(books, delta, "id", ["parse_status"])


def complete(books: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """Parsed books: counts has id and n. Completed, parsed, with the number of chapters and the time."""
    done = counts.select("id", F.col("n").alias("_n"))
    hit = F.col("_n").isNotNull()
    new = {"chapters_parsed": F.lit(True), "chapters_count": F.col("_n"), "parse_status": F.lit("completed"), "last_parsed_at": now, "updated_at": now}
    out = books.join(done, "id", "left")
    return out.select(*(F.when(hit, new[c]).otherwise(F.col(c)).cast(books.schema[c].dataType).alias(c) if c in new else F.col(c) for c in books.columns))


def reset(books: DataFrame, ids: DataFrame) -> DataFrame:
    """Books to be parsed anew: pending, not parsed, without chapters."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    new = {"chapters_parsed": F.lit(False), "chapters_count": F.lit(0), "parse_status": F.lit("pending"), "last_parsed_at": F.lit(None)}
    out = books.join(hit, "id", "left")
    return out.select(*(F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).cast(books.schema[c].dataType).alias(c) if c in new else F.col(c) for c in books.columns))


# ---------------------------------------------------------------- deletes


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the predicate does not hold; rows where it is null stay, as in SQL."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


#: (child, its column, parent, the parent's key): rows of the child vanish with their parent, in this order.
CASCADES = [
    ("books", "source_id", "book_sources", "id"), ("book_documents", "book_id", "books", "id"), ("document_contents", "document_id", "book_documents", "id"),
    ("document_resources", "book_id", "books", "id"), ("book_tags", "book_id", "books", "id"), ("book_tags", "tag_id", "tags", "id"), ("reading_progress", "book_id", "books", "id"),
    ("reading_progress", "user_id", "users", "id"), ("bookmarks", "book_id", "books", "id"), ("bookmarks", "user_id", "users", "id"), ("reader_settings", "user_id", "users", "id"),
]


def cascade(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """After rows of a parent were deleted: every table without rows whose parent is gone; null references stay."""
    out = dict(tables)
    for child, column, parent, key in CASCADES:
        if child in out and parent in out:
            there = out[parent].select(F.col(key).alias(column))
            rows = out[child]
            out[child] = rows.join(there, column, "left_semi").select(rows.columns).unionByName(rows.filter(F.col(column).isNull()))
    return out


def blocked_deletes(users: DataFrame, sessions: DataFrame, invites: DataFrame | None = None) -> DataFrame:
    """Users that cannot be deleted because rows without a cascade refer to them, with the number of such rows."""
    refs = [sessions.select("user_id")]
    if invites is not None:
        refs += [invites.select(F.col("created_by").alias("user_id")), invites.select(F.col("used_by").alias("user_id"))]
    held = reduce(DataFrame.unionByName, refs).filter("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("held_by"))
    return users.select("user_id").join(held, "user_id")


# ---------------------------------------------------------------- others


def new_sessions(logins: DataFrame) -> DataFrame:
    """user_id, token and created_at of logins; the caller brings the tokens, so that the plan can be run again."""
    return logins.select("token", "user_id", "created_at", (F.col("created_at") + F.expr(f"INTERVAL {SESSION_DAYS} DAYS")).alias("expires_at"))


def use_invites(invites: DataFrame, used: DataFrame) -> DataFrame:
    """used: token, used_by, used_at. An invite is used once; one already used keeps its user."""
    u = used.select("token", F.col("used_by").alias("_by"), F.col("used_at").alias("_at"))
    first = Window.partitionBy("token").orderBy("_at", "_by")
    u = u.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    hit = F.col("_by").isNotNull() & ~F.col("used")
    return invites.join(u, "token", "left").select(*(
        F.when(hit, F.col("_by")).otherwise(F.col("used_by")).alias(c) if c == "used_by" else F.when(hit, F.col("_at")).otherwise(F.col("used_at")).alias(c) if c == "used_at" else (F.col("used") | hit).alias(c) if c == "used" else F.col(c)
        for c in invites.columns
    ))


def add_bookmarks(current: DataFrame, new: DataFrame) -> DataFrame:
    """One bookmark per user, book and position: existing ones win, of new ones the earliest. A colour is filled in."""
    keys = ["user_id", "book_id", "position_value"]
    w = Window.partitionBy(*keys).orderBy("created_at", "id")
    fresh = new.join(current.select(*keys), keys, "left_anti").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return current.unionByName(fresh.withColumn("color", F.coalesce("color", F.lit(BOOKMARK_COLOUR))).select(current.columns))


def store_images(images: DataFrame) -> DataFrame:
    """(book_id, name, size): images by content, identical bytes of a book once. images: book_id, content, ext."""
    from librarium.functions.text import content_name

    return images.select("book_id", content_name(F.col("content"), F.col("ext")).alias("name"), F.length("content").cast("bigint").alias("size")).distinct()


def valid_rules(rules: DataFrame) -> DataFrame:
    """Rules whose pattern compiles; the others would be refused. The engine that will run them compiles them.

    Rules are a table kept by hand, as small as it is where they are made one pattern (`segment.header_pattern`).
    """
    pattern = rules.sparkSession._jvm.java.util.regex.Pattern
    refused = []
    for r in rules.select("rule").distinct().toLocalIterator():
        try:
            pattern.compile(r.rule)
        except Exception:  # noqa: BLE001 - whatever the engine says, the rule is refused
            refused.append(r.rule)
    return rules.filter(F.col("rule").isNotNull() & ~F.col("rule").isin([r for r in refused if r is not None]))
