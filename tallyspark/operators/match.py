"""Matching of names and comparison of snapshots, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import edit_budget, folded_name, letters


def lookup(mentions: DataFrame, dim: DataFrame, mention: str = "mention", name: str = "name", key: str = "id") -> DataFrame:
    """Mention to candidates: all of a mention's words are in the name; a mention that is a whole name takes only that.

    Whole names are one join. Any other mention meets only the names that hold
    its rarest word, by how many names have each; its other words are looked
    for in place. So a word that very many names share costs nothing but for a
    mention that has no other.
    """
    m = mentions.select(F.col(mention).alias("mention")).distinct().withColumn("said", letters(F.col("mention"))).where(F.size("said") > 0)
    d = dim.select(F.col(key).alias("id"), letters(F.col(name)).alias("words")).where(F.size("words") > 0)
    whole = lambda c: F.array_join(c, " ")
    exact = m.select("mention", whole("said").alias("_w")).join(d.select("id", whole("words").alias("_w")), "_w").select("mention", "id", F.lit(True).alias("exact"))
    rest = m.join(exact.select("mention"), "mention", "left_anti").withColumn("said", F.array_distinct("said"))
    index = d.withColumn("words", F.array_distinct("words")).select("id", "words", F.explode("words").alias("w"))
    often = index.groupBy("w").agg(F.count("*").alias("_n"))
    # a word that no name holds leaves its mention without candidates
    seen = rest.select("mention", "said", F.explode("said").alias("w")).join(often, "w")
    rarest = seen.groupBy("mention", "said").agg(F.min(F.struct("_n", "w")).alias("_r"), F.count("*").alias("_k")).where(F.col("_k") == F.size("said"))
    met = rarest.select("mention", "said", F.col("_r.w").alias("w")).join(index, "w").where(F.size(F.array_except("said", "words")) == 0)
    return exact.unionByName(met.select("mention", "id", F.lit(False).alias("exact")))


def _deletes(frame: DataFrame, word: str) -> DataFrame:
    """Each word with every way to leave out as many letters as its budget, or fewer."""
    one = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    first = F.when(F.col("budget") >= 1, one(F.col(word))).otherwise(F.array().cast("array<string>"))
    second = F.when(F.col("budget") >= 2, F.flatten(F.transform(first, one))).otherwise(F.array().cast("array<string>"))
    return frame.withColumn("form", F.explode(F.array_distinct(F.concat(F.array(F.col(word)), first, second))))


def edits(one: str, other: str) -> int:
    """Edits of UTF-8 bytes with swaps of neighbours, of which the swapped ones may be edited again."""
    a, b = one.encode(), other.encode()
    far = len(a) + len(b)
    last: dict[int, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, at = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), at
            cost = 0 if x == y else 1
            if not cost:
                at = j
            swap = rows[k][m] + (i - k - 1) + 1 + (j - m - 1)
            row.append(min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, swap))
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (word, near, gap) of distinct words within the budget of the first: candidates share a form with letters left out, and the survivors are measured, in the JVM."""
    a = left.select("word").distinct().withColumn("budget", edit_budget(F.col("word")))
    b = right.select(F.col("word").alias("near")).distinct().withColumn("budget", F.lit(2))
    pairs = _deletes(a, "word").select("word", "form", F.col("budget").alias("most")).join(_deletes(b, "near").select("near", "form"), "form").select("word", "near", "most").distinct()
    # a swap is two plain edits, and a character is a byte at least
    pairs = pairs.where(F.levenshtein("word", "near") <= 2 * F.col("most"))

    return pairs.withColumn("gap", near_edits(F.col("word"), F.col("near"))).where("gap <= most").select("word", "near", "gap")


def near_edits(one: Column, other: Column) -> Column:
    """``edits`` of two texts where there are at most two, and a larger number where there are more.

    A distance of two stays within two places of the diagonal, so a row is five
    numbers; a swap of neighbours reaches two rows back, and one with a byte
    put in or left out between them three.
    """
    a, b = F.regexp_extract_all(F.hex(one), F.lit(".."), F.lit(0)), F.regexp_extract_all(F.hex(other), F.lit(".."), F.lit(0))
    far = 9
    row = lambda *v: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in v]).cast("array<int>")
    state = lambda r1, r2, r3: F.struct(r1.alias("r1"), r2.alias("r2"), r3.alias("r3"))

    def step(rows: Column, i: Column) -> Column:
        x = lambda back: F.get(a, i - 1 - back)
        base = []
        for p in range(5):
            j = i + (p - 2)
            y = lambda back, j=j: F.when(j - back >= 1, F.get(b, j - 1 - back))
            cell = lambda r, q: F.get(rows[r], F.lit(q)) if 0 <= q < 5 else F.lit(far)
            swap = lambda u, v: F.coalesce((x(0) == y(v)) & (x(u) == y(0)), F.lit(False))
            least = F.least(
                cell("r1", p) + F.when(x(0) == y(0), 0).otherwise(1), cell("r1", p + 1) + 1,
                F.when((i >= 2) & swap(1, 1), cell("r2", p) + 1).otherwise(far), F.when((i >= 3) & swap(2, 1), cell("r3", p + 1) + 2).otherwise(far), F.when((i >= 2) & swap(1, 2), cell("r2", p - 1) + 2).otherwise(far),
            )
            base.append(F.when(j < 0, F.lit(far)).when(j == 0, i).otherwise(least))
        start = row(*base)
        # what a byte put in adds, from the left
        new = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: F.array_min(F.transform(F.slice(start, F.lit(1), p + 1), lambda v, q: v + p - q)))
        return state(new, rows["r1"], rows["r2"])

    first = state(row(far, far, 0, 1, 2), row(*[far] * 5), row(*[far] * 5))
    n, m = F.size(a), F.size(b)
    last = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), first, step)
    return F.when(F.abs(n - m) <= 2, F.least(F.get(last["r1"], m - n + 2), F.lit(far))).otherwise(far)


def near_spelling(mentions: DataFrame, dim: DataFrame, mention: str = "mention", name: str = "name", key: str = "id") -> DataFrame:
    """Mention to names of which every word is near one of its words; the sum of the gaps ranks.

    A mention meets only the names that hold a word near to that one of its
    words for which there are fewest; its other words are measured in place.
    Ids of one name meet as that name, and are put to it at the end: names that
    very many ids share are then few rows, which need no shuffle by name.
    """
    m = mentions.select(F.col(mention).alias("mention")).distinct().withColumn("ws", F.array_distinct(letters(F.col("mention"))))
    mw = m.select("mention", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    d = dim.select(F.col(key).alias("id"), F.array_distinct(letters(F.col(name))).alias("words")).where(F.size("words") > 0)
    index = d.select("words").distinct().select("words", F.explode("words").alias("near"))
    gaps = near_words(mw.select("word"), index.select(F.col("near").alias("word")))
    often = index.groupBy("near").agg(F.count("*").alias("_n"))
    # of a word's near words there are few: their number is bounded by the vocabulary within two edits
    near = gaps.join(often, "near").groupBy("word").agg(F.sum("_n").alias("_n"), F.collect_list(F.struct("near", "gap")).alias("_near"))
    own = mw.join(near, "word").groupBy("mention", "n").agg(F.min(F.struct("_n", "word", "_near")).alias("_r"), F.collect_list("_near").alias("_all")).where(F.size("_all") == F.col("n"))
    met = own.select("mention", "_all", F.explode(F.col("_r._near.near")).alias("near")).join(index, "near").select("mention", "_all", "words").dropDuplicates(["mention", "words"])
    least = F.transform("_all", lambda near: F.array_min(F.transform(F.filter(near, lambda x: F.array_contains(F.col("words"), x["near"])), lambda x: x["gap"])))
    out = met.withColumn("_gaps", least).where(~F.exists("_gaps", lambda g: g.isNull()))
    out = out.select("mention", "words", F.aggregate("_gaps", F.lit(0).cast("long"), lambda a, g: a + g).alias("gap"))
    # an id of several names has the nearest of them
    return out.join(d, "words").groupBy("mention", "id").agg(F.min("gap").alias("gap"))


def eliminate(candidates: DataFrame, facts: DataFrame, entity: str = "id", season: str = "season", asked: int | None = None) -> DataFrame:
    """Candidates with rows in the season asked for; if a mention has none, those with rows in the latest season."""
    latest = F.broadcast(facts.agg(F.max(season).alias("_last")))
    seen = facts.groupBy(entity).agg(F.collect_set(season).alias("_in"))
    rows = candidates.join(seen, entity, "left").join(latest)
    rows = rows.withColumn("_asked", F.coalesce(F.array_contains("_in", asked), F.lit(False)) if asked is not None else F.lit(False)).withColumn("_now", F.coalesce(F.expr("array_contains(_in, _last)"), F.lit(False)))
    any_ = rows.groupBy("mention").agg(F.bool_or("_asked").alias("_any"))
    return rows.join(any_, "mention").where("(_any and _asked) or (not _any and _now)").select(*candidates.columns)


def companions(candidates: DataFrame, facts: DataFrame, entity: str = "id", subject: str = "subject", shared: tuple[str, ...] = ("season", "group")) -> DataFrame:
    """Candidates who were with their mention's subject: in one of the subject's groups in one of its seasons. A mention may be left without any."""
    seen = facts.select(F.col(entity).alias("_e"), *shared).where("_e is not null").distinct()
    keys = candidates.select(entity, subject).distinct()
    his = keys.join(seen.withColumnRenamed("_e", subject), subject)
    met = his.join(seen.withColumnRenamed("_e", entity), [entity, *shared], "left_semi").select(entity, subject)
    return candidates.join(met, [entity, subject], "left_semi").select(*candidates.columns)


def alias_lookup(mentions: DataFrame, aliases: DataFrame, season: str = "season") -> DataFrame:
    """Mentions that are an alias in their season; aliases are a short table of (alias, id, first, last)."""
    a = aliases.select(F.lower("alias").alias("_a"), F.col("id"), F.col("first").alias("_f"), F.coalesce("last", F.lit(9999)).alias("_l"))
    return mentions.join(a, (F.lower("mention") == F.col("_a")) & F.col(season).between(F.col("_f"), F.col("_l"))).drop("_a", "_f", "_l")


def resolve_names(rows: DataFrame, dim: DataFrame, name: str, key: str, events: DataFrame | None = None, event: str = "event") -> DataFrame:
    """A row's id by its exact name, else by its folded name; names of several ids resolve to nothing.

    With ``events`` (columns of ``key`` and ``event``), a name of two ids that share an event resolves to the
    established one: the id with more events, the lesser id of a tie.
    """

    def one(c):
        ids = dim.select(c.alias("_n"), F.col(key).alias("_id")).where("_n is not null").distinct()
        n = ids.groupBy("_n").agg(F.min("_id").alias("_id"), F.max("_id").alias("_b"), F.count("*").alias("_k"))
        alone = n.where("_k = 1").select("_n", "_id")
        if events is None:
            return alone
        seen = events.select(F.col(key).alias("_x"), F.col(event).alias("_ev")).where("_x is not null and _ev is not null").distinct()
        pairs = n.where("_k = 2").select("_n", F.explode(F.array("_id", "_b")).alias("_x"))
        held = pairs.join(seen, "_x")
        shared = held.groupBy("_n", "_ev").agg(F.count("*").alias("_c")).where("_c = 2").select("_n").distinct()
        most = held.join(shared, "_n", "left_semi").groupBy("_n", "_x").agg(F.count("*").alias("_c")).groupBy("_n").agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col("_x").alias("x"))).alias("_m"))
        return alone.unionByName(most.select("_n", F.col("_m.x").alias("_id")))

    exact, fold = one(F.col(name)), one(folded_name(F.col(name)))
    out = rows.join(exact.select(F.col("_n").alias("_n1"), F.col("_id").alias("_e")), F.col(name) == F.col("_n1"), "left")
    out = out.join(fold.select(F.col("_n").alias("_n2"), F.col("_id").alias("_f")), folded_name(F.col(name)) == F.col("_n2"), "left")
    return out.withColumn(key, F.coalesce("_e", "_f")).drop("_n1", "_n2", "_e", "_f")


def keyed_diff(before: DataFrame, after: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row for each key that differs: the first differing column by name, its kind, and both values.

    Kinds: ``missing`` and ``added`` keys, ``type`` where one value is null, ``reordered`` lists, ``changed``. Numbers within the tolerance, relative above 1, are equal.
    """
    cols = sorted(c for c in before.columns if c not in key and c in after.columns)
    b = before.select(*key, F.struct(*cols).alias("_b"))
    a = after.select(*key, F.struct(*cols).alias("_a"))
    both = b.join(a, key, "full")
    kinds = dict(before.dtypes)

    def entry(c):
        x, y = F.col(f"_b.{c}"), F.col(f"_a.{c}")
        if kinds[c].startswith(("double", "float", "decimal", "int", "bigint")):
            same = F.abs(x.cast("double") - y.cast("double")) <= tolerance * F.greatest(F.lit(1.0), F.abs(x.cast("double")), F.abs(y.cast("double")))
        else:
            same = x == y
        reordered = F.array_sort(x) == F.array_sort(y) if kinds[c].startswith("array") else F.lit(False)
        kind = F.when(x.isNull() & y.isNull(), None).when(x.isNull() | y.isNull(), "type").when(same, None).when(reordered, "reordered").otherwise("changed")
        return F.struct(F.lit(c).alias("path"), kind.alias("kind"), x.cast("string").alias("before"), y.cast("string").alias("after"))

    whole = lambda k: F.struct(F.lit("").alias("path"), F.lit(k).alias("kind"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    first = F.try_element_at(F.filter(F.array(*[entry(c) for c in cols]), lambda e: e["kind"].isNotNull()), F.lit(1))
    d = F.when(F.col("_a").isNull(), whole("missing")).when(F.col("_b").isNull(), whole("added")).otherwise(first)
    return both.select(*key, d.alias("_d")).where("_d is not null").select(*key, "_d.*")
