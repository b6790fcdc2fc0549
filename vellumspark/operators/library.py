"""Jobs, playlists and their states: ordering, numbering, roll-ups, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import license as L
from vellumspark.functions import text as T


def pasted(rows: DataFrame, key: str) -> DataFrame:
    """(key, line, preprint, other) of pasted texts."""
    lines = rows.select(key, F.posexplode(F.split("text", "\r?\n")).alias("line", "s")).withColumn("ids", L.preprint_ids(F.col("s")))
    links = F.filter(F.regexp_extract_all("s", F.lit(r"(https?://\S+)"), F.lit(1)), lambda u: ~u.contains("arxiv.org"))
    other = F.when((F.size("ids") == 1) & (F.size(links) > 0), links[0]).otherwise("")
    each = lines.select(key, "line", other.alias("other"), F.posexplode("ids").alias("k", "preprint"))
    first = Window.partitionBy(key, "preprint").orderBy("line", "k")
    return each.withColumn("r", F.row_number().over(first)).where("r = 1").select(key, "line", "preprint", "other")


def paper_date(published: Column, year: Column) -> Column:
    return F.when(F.coalesce(published, F.lit("")) != "", published).when(year.isNotNull(), F.concat(year.cast("string"), F.lit("-12-31"))).otherwise("")


def ordered(items: DataFrame, by: str, order: str) -> DataFrame:
    """Items (by, pos, title, published, year, added, made) with ``place`` 1 .. n in each playlist.

    order: paper_date, paper_date_desc (the tie-break on titles is turned too), made (unmade last) or added. Undated
    items go last, as they were added to the list.
    """
    date = paper_date(F.col("published"), F.col("year"))
    dated = F.when(date != "", 0).otherwise(1)
    tail = F.when(date == "", F.col("pos"))
    keys = {
        "paper_date": [dated, F.when(date != "", date), F.when(date != "", F.col("title")), tail, F.col("pos")],
        "paper_date_desc": [dated, F.when(date != "", date).desc(), F.when(date != "", F.col("title")).desc(), tail, F.col("pos").desc()],
        "made": [F.col("made").asc_nulls_last(), date, F.col("pos")],
        "added": [F.coalesce("added", F.lit(0.0)), F.col("pos")],
    }[order]
    return items.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*keys)))


def folder_number(name: Column) -> Column:
    """``03 - A Paper`` -> 3, else null."""
    return F.regexp_extract(name, r"^(\d+) - ", 1).try_cast("int")


def unnumbered(name: Column) -> Column:
    return F.regexp_replace(name, r"^\d+ - ", "")


def numbered(n: Column, paper: Column) -> Column:
    return F.concat(F.format_string("%02d", n), F.lit(" - "), paper)


def numbers_for(papers: DataFrame, owned: DataFrame, folders: DataFrame, library: tuple[str, ...] = ()) -> DataFrame:
    """(library, job, paper, n): the number that a job's paper holds, else one above all numbers in use in its library.

    papers: (library, job, paper); owned: (library, name, job); folders: (library, name). Without ``library`` all are of
    one. New papers are numbered in a window of their library alone.
    """
    if not library:
        one = [df.withColumn("library", F.lit(1)) for df in (papers, owned, folders)]
        return numbers_for(*one, ("library",)).drop("library")
    used = owned.select(*library, "name").unionByName(folders.select(*library, "name")).groupBy(*library).agg(F.max(folder_number(F.col("name"))).alias("most"))
    held = owned.select(*library, "job", unnumbered(F.col("name")).alias("paper"), folder_number(F.col("name")).alias("held"))
    fresh = Window.partitionBy(*library, F.col("held").isNull()).orderBy("job", "paper")
    joined = papers.join(held, [*library, "job", "paper"], "left").join(used, [*library], "left")
    return joined.select(*library, "job", "paper", F.coalesce("held", F.coalesce("most", F.lit(0)) + F.row_number().over(fresh)).cast("int").alias("n"))


def stage_progress(stages: DataFrame, key: str) -> DataFrame:
    """(key, progress, finished): mean progress of the stages (done and skipped ones count 1), and whether all are finished."""
    over = F.col("status").isin("done", "skipped")
    return stages.groupBy(key).agg(F.bround(F.avg(F.when(over, 1.0).otherwise(F.coalesce("progress", F.lit(0.0)))), 4).alias("progress"), F.every(over).alias("finished"))


def job_state(done: Column, stopped: Column, error: Column, running: Column, queued: Column, progress: Column) -> Column:
    return (
        F.when(done, "done").when(stopped, "license").when(error.isNotNull(), "error").when(running, "making").when(queued, "waiting")
        .when(progress == 0, "not started").otherwise("paused")
    )


def playlist_totals(items: DataFrame, by: str) -> DataFrame:
    """Seconds, number, states, span of dates and first four thumbnails of each playlist; items have (by, place, state, seconds, published, thumb)."""
    states = items.groupBy(by, "state").agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "n")))).alias("states"))
    dated = F.when(F.col("published") != "", F.col("published"))
    thumbs = F.transform(F.sort_array(F.collect_list(F.when(F.col("thumb").isNotNull(), F.struct("place", "thumb")))), lambda t: t["thumb"])
    sums = items.groupBy(by).agg(
        F.count("*").alias("papers"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.min(dated).alias("first"), F.max(dated).alias("last"), F.slice(thumbs, 1, 4).alias("thumbs")
    )
    return sums.join(states, by)


#: Parts into which the jobs of one key are dealt, so that a common key is not one task.
SHARES = 16


def same_paper(papers: DataFrame, jobs: DataFrame) -> DataFrame:
    """(paper, job) of jobs with a paper's identifier or (letters and digits) title: an OR as one equi join of keys.

    A pair that shares several keys is kept at the least of them, so pairs need no exchange to be distinct. At the first
    key of either side that is settled; the keys themselves are compared at the others only.
    """

    def keyed(rows: DataFrame, who: str, side: str) -> DataFrame:
        of = lambda c, kind: F.when(c != "", F.concat(F.lit(kind), c))
        each = rows.select(who, F.explode(F.array(of(F.col("preprint"), "i"), of(T.squash(F.col("title")), "t"))).alias("k")).where("k IS NOT NULL")
        sets = each.groupBy(who).agg(F.array_sort(F.collect_set("k")).alias("keys"))
        out = sets.select(who, "keys", F.posexplode("keys").alias("at", "k"))
        return out.select(who, "k", F.when(F.col("at") > 0, F.col("keys")).alias(side))

    share = F.pmod(F.xxhash64("job"), F.lit(SHARES))
    a = keyed(papers, "paper", "a").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    met = keyed(jobs, "job", "b").withColumn("share", share).hint("merge").join(a, ["k", "share"])
    least = F.col("a").isNull() | F.col("b").isNull() | (F.col("k") == F.array_min(F.array_intersect("a", "b")))
    return met.where(least).select("paper", "job")


def reusable(pairs: DataFrame, jobs: DataFrame, depth: Column) -> DataFrame:
    """For each paper the newest job of the depth, else the newest that can be derived from (its first stages are done)."""
    rows = pairs.join(jobs, "job")
    rank = F.when(F.col("depth") == depth, 0).when(F.col("derivable"), 1)
    best = Window.partitionBy("paper").orderBy("rank", F.desc("job"))
    return rows.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("r", F.row_number().over(best)).where("r = 1").select("paper", "job", F.when(F.col("rank") == 0, "same").otherwise("derive").alias("how"))


def queue_plan(items: DataFrame) -> DataFrame:
    """(playlist, place, title, action, reason): what making a playlist does with each item, in its order."""
    lic = F.when(F.coalesce("license", F.lit("")) == "", "none found").otherwise(F.col("license"))
    allowed = F.col("allowed") | F.col("permission")
    reason = (
        F.when((F.col("status") != "ready") & F.col("job").isNull(), F.when(F.col("status") == "fetching", "still being fetched").otherwise(F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("not fetched"))))
        .when(~allowed & F.col("job").isNull(), F.concat(F.lit("its license ("), lic, F.lit(") does not allow a video")))
        .when((F.col("state") != "done") & ~allowed, F.concat(F.lit("license ("), lic, F.lit(") does not allow a video; open the job to record permission")))
    )
    action = F.when(reason.isNotNull(), "skip").when(F.col("state") == "done", "keep").when(F.col("state").isin("making", "waiting"), "queued").when(F.col("state") == "error", "retry").otherwise("start")
    return items.select("playlist", "place", "title", action.alias("action"), reason.alias("reason"))


def safe_name(title: Column, venue: Column, year: Column, limit: int = 90, said: Column | None = None) -> Column:
    """A file stem ``Title (Venue Year)`` of at most ``limit`` characters; the tail stays whole where the title is cut.
    Venue and year are left out where ``said`` (the title, if not given) has them: digits of a key in it say no year."""
    squeeze = lambda c, d: F.trim(F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit(d)), r"\s+", " "))
    t, v, y = squeeze(title, "Untitled"), squeeze(venue, ""), F.coalesce(year.cast("string"), F.lit(""))
    has = t if said is None else squeeze(said, "")
    v = F.when((v != "") & F.contains(has, v), "").otherwise(v)
    y = F.when((y != "") & (F.contains(has, y) | F.contains(v, y)), "").otherwise(y)
    tail = F.when((v != "") | (y != ""), F.concat(F.lit("("), v, F.when((v != "") & (y != ""), " ").otherwise(""), y, F.lit(")"))).otherwise("")
    raw = F.trim(F.concat(t, F.lit(" "), tail))
    stem = F.regexp_replace(F.replace(F.regexp_replace(raw, r'[/\\:*?"<>|\x00-\x1f]', ""), F.lit(" - "), F.lit(" ")), r"[ .]+$", "")
    head = F.substring(stem, F.lit(1), F.greatest(F.lit(1), F.lit(limit - 4) - F.length(tail)))
    cut = F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("..."), F.when(tail != "", F.concat(F.lit(" "), tail)).otherwise(""))
    return F.when(stem == "", "Untitled").when(F.length(stem) > limit, cut).otherwise(stem)


def short_title(title: Column) -> Column:
    head = F.trim(F.element_at(F.split(F.trim(title), r"\s*[:?]\s+", 2), 1))
    return F.when(F.length(head).between(2, 40), head).otherwise(F.trim(title))


def video_title(title: Column, kind: Column, most: int = 100) -> Column:
    """``title | kind`` in ``most`` characters: whole, else its short form, else cut at a word."""
    whole = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(F.nullif(title, F.lit("")), F.lit("A research paper")), r"\s+", " ")), r"\.+$", "")
    short = short_title(whole)
    fits = lambda t: F.length(t) + F.length(kind) + 3 <= most
    cut = F.concat(F.regexp_replace(F.substring(short, F.lit(1), F.lit(most - 6) - F.length(kind)), r" [^ ]*$", ""), F.lit("..."))
    return F.concat(F.when(fits(whole), whole).when(fits(short), short).otherwise(cut), F.lit(" | "), kind)


def within_budget(tags: Column, most: int = 500) -> Column:
    """Tags in order, without repeats by case, as many as fit; one that doesn't fit is passed over."""
    clean = F.transform(tags, lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), "[<>,]", "")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        take = (t != "") & ~F.array_contains(F.transform(acc["kept"], F.lower), F.lower(t)) & (acc["n"] + F.length(t) + 1 <= most)
        return F.struct(
            F.when(take, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"),
            F.when(take, acc["n"] + F.length(t) + 1).otherwise(acc["n"]).alias("n"),
        )

    return F.aggregate(clean, start, step, lambda acc: acc["kept"])


def memo(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JON-14: requests (name, model, prompt) with cached answers, and those still to be asked. Failures are never stored."""
    key = F.sha1(F.concat_ws("|", F.lit("v1"), "name", "model", "prompt").cast("binary"))
    keyed = requests.withColumn("key", key)
    return keyed.join(cache, "key", "left"), keyed.join(cache, "key", "left_anti")
