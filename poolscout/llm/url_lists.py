"""URL filters by dated lists: entries become validity intervals, captures are judged by the entries active when fetched.

A list is a table of events ``(key, action, day, category)``: from ``day`` on, ``key`` (a host, a domain above it, or a host with a
leading path) is on the list (``add``) or off it (``remove``). A capture is judged by every key of its URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The day that no interval reaches.
NEVER = "9999-12-31"


def intervals(events: DataFrame) -> DataFrame:
    """``(key, category, valid_from, valid_to)``, half open, from ``(key, action, day, category)``.

    An event holds until the next event of its key and category. Of several events on one day the last wins, where ``remove`` comes
    after ``add``; repeated rows change nothing. Events without key, day or a known action are ignored, a null category is ``''``.
    """
    rows = events.select(
        F.lower(events["key"]).alias("key"),
        F.coalesce(events["category"], F.lit("")).alias("category"),
        events["day"].cast("date").alias("valid_from"),
        F.lower(events["action"]).alias("action"),
    ).where("key IS NOT NULL AND valid_from IS NOT NULL AND action IN ('add', 'remove')")
    # 'remove' > 'add': the greatest action of a day is the last one
    daily = rows.groupBy("key", "category", "valid_from").agg(F.max("action").alias("action"))
    order = Window.partitionBy("key", "category").orderBy("valid_from")
    until = F.coalesce(F.lead("valid_from").over(order), F.lit(NEVER).cast("date"))
    return daily.withColumn("valid_to", until).where("action = 'add'").select("key", "category", "valid_from", "valid_to")


def host_of(url: str | Column) -> Column:
    """Lower-case host, without user, port and final dot; null for a URL that has none."""
    column = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(F.lower(column), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)
    return F.when(found != "", found)


def path_of(url: str | Column) -> Column:
    column = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.lower(column), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def url_keys(url: str | Column, labels: int | None = None, steps: int | None = None) -> Column:
    """Every key that can list the URL: its host, the domains above it of two labels or more, and the host with each leading path.

    With ``labels`` and ``steps`` only the domains of at most so many labels and the paths of at most so many steps: a list without
    longer ones can't be met by others, and the keys of a very long URL stay few.
    """
    host = host_of(url)
    parts = F.split(host, r"\.")
    count = F.size(parts)
    low = F.lit(2) if labels is None else F.greatest(F.lit(2), count + F.lit(1 - labels))
    above = F.when(low < count, F.transform(F.sequence(low, count - 1), lambda k: F.array_join(F.slice(parts, k, count), ".")))
    path = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    path = path if steps is None else F.slice(path, 1, max(1, steps))
    paths = F.when(
        F.size(path) > 0,
        F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), k), "/"))),
    )
    empty = F.array().cast("array<string>")
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(host), F.coalesce(above, empty), F.coalesce(paths, empty))))


def judge(captures: DataFrame, valid: DataFrame, id_col: str, url_col: str, day_col: str, salts: int = 16) -> DataFrame:
    """One row per row of ``captures``: ``(id, day, host, n_active, active_key, category, listed)``.

    ``n_active`` counts the entries that are active for any key on the capture's day; the reported entry is the most specific one
    (longest key, then the smaller key and category). A capture without URL, host or day has no active entry. Repeated rows, and
    rows without an id, are captures like any other.

    Each URL and day is judged once and the verdict joined back, so a capture that is repeated in a third of the table is one row
    per task in the aggregate and meets a single row in the join. Captures of a host that holds a third of the table are spread
    over ``salts`` parts, to which the list rows are copied; the list is never broadcast by hand. Two numbers of the list, its
    deepest domain and path, come to the driver and bound the keys of a URL.
    """
    rows = captures.select(
        captures[id_col].alias("id"), captures[url_col].cast("string").alias("url"), captures[day_col].cast("date").alias("day")
    ).withColumn("host", host_of("url"))
    depth = valid.select(
        F.size(F.split(F.element_at(F.split("key", "/"), 1), r"\.")).alias("labels"), (F.size(F.split("key", "/")) - 1).alias("steps")
    ).agg(F.max("labels").alias("labels"), F.max("steps").alias("steps")).first()
    asked = rows.where("host IS NOT NULL AND day IS NOT NULL").select("url", "day").distinct()
    keyed = asked.select("*", F.explode(url_keys("url", depth["labels"] or 0, depth["steps"] or 0)).alias("key"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("url", "day"), F.lit(salts)).cast("int"))
    copies = valid.select(
        F.col("key").alias("active"), "category", "valid_from", "valid_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part")
    )
    on = (
        (keyed["key"] == copies["active"])
        & (keyed["salt"] == copies["part"])
        & (copies["valid_from"] <= keyed["day"])
        & (keyed["day"] < copies["valid_to"])
    )
    entry = F.struct((-F.length("active")).alias("l"), "active", "category")
    # a capture has few keys, so its set of active entries is short
    verdicts = (
        keyed.join(copies, on)
        .groupBy("url", "day")
        .agg(F.size(F.collect_set(entry)).cast("long").alias("n"), F.min(entry).alias("best"))
    )
    n = F.coalesce("n", F.lit(0).cast("long"))
    return rows.join(verdicts, ["url", "day"], "left").select(
        "id", "day", "host", n.alias("n_active"), F.col("best.active").alias("active_key"), F.col("best.category").alias("category"), (n > 0).alias("listed")
    )
