"""Relations between documents and what follows from them: citations, repeals, validity, chains of repeals.

Documents name others by title or by number. Numbers are joined; titles are matched to the best partial match among all
titles. Relations are written before anything is judged, as a document read early may be repealed by one read late.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import identifiers as I
from lexmill.operators.closest import closest_titles, likely_titles
from lexmill.operators.fuzzy import whole_titles
from lexmill.plans.storage import discard, materialize

#: Least partial ratios: for cited titles, for objects of repeal, for titles in an official catalogue.
CITED, REPEALED, LISTED = 90, 88, 92
_COLUMNS = ("src", "relation", "dst", "dst_no", "evidence", "evidence_source", "confidence")


def best_titles(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """mentions (src, key, least, acts, ...) with `dst` and `score`: of the documents other than src the one whose title
    matches key best, the smaller id on ties; null below `least`. docs has doc_id and key, its title in comparable form.

    Where `acts` is set, statutes are passed over, as no other document repeals them; so are interpretations, wherever
    the key isn't that of one. Equal keys are matched once, and equal titles stand as one with their two smallest ids,
    enough for any src, so a title that a third of all documents have is one row. Keys that are, hold or stand in whole
    titles are settled first, by one rare n-gram each; the closest titles are searched for the others alone, from the score
    of a likely one on.
    """
    by_title = Window.partitionBy("key").orderBy("doc_id")
    holders = docs.filter("key != ''").select("key", "doc_id").withColumn("nth", F.row_number().over(by_title)).filter("nth <= 2").drop("nth")
    wanted = mentions.select("key", "acts").filter("key != ''").distinct()
    least = mentions.agg(F.min("least")).first()[0]
    if least is None:
        return mentions.withColumn("dst", F.lit(None).cast("long")).withColumn("score", F.lit(None).cast("int"))
    allowed = (~F.col("acts") | ~F.col("b").rlike(I.STATUTE)) & (~I.interprets(F.col("b")) | F.contains("key", F.lit("解读")))
    order = Window.partitionBy("key", "acts").orderBy(F.col("score").desc(), "doc_id")

    def best(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
        """(key, acts, top): the two best documents, in order."""
        found = wanted.join(pairs.hint("merge"), wanted.key == pairs.a).filter(allowed).select("key", "acts", "b", "score").join(holders.select(F.col("key").alias("b"), "doc_id").hint("merge"), "b")
        top = found.withColumn("nth", F.row_number().over(order)).filter("nth <= 2")
        return top.groupBy("key", "acts").agg(F.array_sort(F.collect_list(F.struct("nth", "doc_id", "score"))).alias("top"))

    titles = holders.select(F.col("key").alias("title"))
    whole = best(wanted, whole_titles(wanted.select(F.col("key").alias("title")), titles).withColumn("score", F.lit(100)))
    # nothing is better than a whole title; a second one is asked for only where the first is the document itself
    alone = F.max(F.coalesce(F.col("src") == F.col("top")[0]["doc_id"], F.lit(False))) & (F.size(F.first("top")) < 2)
    whole = materialize(mentions.select("key", "acts", "src").join(whole.hint("merge"), ["key", "acts"]).groupBy("key", "acts").agg(F.first("top").alias("top"), alone.alias("alone")).filter("not alone").drop("alone"))
    rest = materialize(wanted.join(whole.select("key", "acts").hint("merge"), ["key", "acts"], "left_anti"))
    likely = likely_titles(rest.select(F.col("key").alias("title")), titles, least)
    # for every src some document is known with the score from which the best are searched for
    known = best(rest, likely.filter("score is not null"))
    other = F.get(F.filter("top", lambda t: F.coalesce(t["doc_id"] != F.col("src"), F.lit(True))), 0)["score"]
    asked = mentions.select("key", "acts", "src", "least").join(rest.hint("merge"), ["key", "acts"]).join(known.hint("merge"), ["key", "acts"], "left")
    asked = asked.groupBy("key", "acts").agg(F.greatest(F.min("least"), F.min(F.coalesce(other, F.lit(0)))).alias("least"))
    bars = F.when(F.col("acts"), 1).otherwise(0) + F.when(F.contains("key", F.lit("解读")), 0).otherwise(2)
    lefts = asked.join(likely.select(F.col("a").alias("key")).distinct().hint("merge"), "key", "left_semi").select(F.col("key").alias("a"), bars.alias("bars"), "least")
    marks = F.when(F.col("b").rlike(I.STATUTE), 1).otherwise(0) + F.when(I.interprets(F.col("b")), 2).otherwise(0)
    rights = holders.filter("doc_id is not null").groupBy(F.col("key").alias("b")).agg(F.min("doc_id").alias("rank")).select("b", marks.alias("marks"), "rank")
    closest = closest_titles(materialize(lefts), materialize(rights)).groupBy("a", "b").agg(F.max("score").alias("score"))
    top = whole.unionByName(best(rest, closest))
    joined = mentions.join(top.hint("merge"), ["key", "acts"], "left").withColumn("top", F.get(F.filter("top", lambda t: F.coalesce(t["doc_id"] != F.col("src"), F.lit(True))), 0))
    enough = F.col("top.score") >= F.col("least")
    return joined.withColumn("dst", F.when(enough, F.col("top.doc_id"))).withColumn("score", F.when(enough, F.col("top.score"))).drop("top")


def _rows(df: DataFrame, relation: str, source: str, dst: Column, dst_no: Column, evidence: Column, confidence: Column) -> DataFrame:
    return df.select("src", F.lit(relation).alias("relation"), dst.cast("long").alias("dst"), dst_no.cast("string").alias("dst_no"), evidence.alias("evidence"), F.lit(source).alias("evidence_source"), confidence.alias("confidence"))


def build_relations(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The relation table (src, relation, dst, dst_no, evidence, evidence_source, confidence) of docs, written.

    docs has doc_id, title, number, text (body and attachments) and catalog, array<struct<title, number>> of what an
    official catalogue lists (null for other documents). Relations are `cites`, `repeals` and `self_repealed`; dst is null
    where nothing of the collection is meant. A target is looked up by number, held by the document of the greatest
    id, else by best_titles. Documents don't cite themselves, nor are they taken for the best title of what they name;
    statutes repeal nothing, interpretations don't report their own repeal. dst_no is the number of what was found by
    title, else what the text says.

    `held` is a table of earlier relations: what people or catalogues entered stays, what was derived is made anew, so a
    second run gives the same table. One row stands for (src, relation, dst, dst_no), official rows before derived ones.
    Rows of docs without a doc_id are passed over; null titles, numbers and texts mention nothing and are not found.
    """
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "title", "number", "text", "catalog")
    facts = own.select(
        "doc_id",
        I.title_key(F.col("title")).alias("key"),
        I.number_key(F.col("number")).alias("own_no"),
        "number",
        F.coalesce(F.col("title").rlike(I.STATUTE), F.lit(False)).alias("statute"),
        F.when(~I.interprets(F.col("title")), I.own_repeal(F.col("text"))).alias("own_repeal"),
        I.mentioned_titles(F.col("text")).alias("titles"),
        I.mentioned_numbers(F.col("text")).alias("numbers"),
        I.repeal_objects(F.col("text")).alias("objects"),
        "catalog",
    )
    facts = materialize(facts)
    holders = facts.filter("own_no is not null").groupBy(F.col("own_no").alias("no_key")).agg(F.max("doc_id").alias("holder"))
    src = F.col("doc_id").alias("src")
    none = F.lit(None).cast("string")

    cited = facts.select(src, F.col("key").alias("own"), F.explode("titles").alias("key")).filter("key != own")
    cited = cited.select("src", "key", F.col("key").alias("said"), none.alias("no_key"), F.lit(CITED).alias("least"), F.lit(False).alias("acts"), F.lit("cites").alias("kind"))
    objects = facts.filter("not statute").select(src, F.explode("objects").alias("said"))
    objects = objects.select("src", I.title_key(F.col("said")).alias("key"), "said", I.number_key(F.col("said")).alias("no_key"), F.lit(REPEALED).alias("least"), F.lit(True).alias("acts"), F.lit("repeals").alias("kind"))
    listed = facts.select(src, F.explode("catalog").alias("r")).select("src", I.title_key(F.col("r.title")).alias("key"), F.coalesce("r.number", "r.title").alias("said"), I.number_key(F.col("r.number")).alias("no_key"), F.lit(LISTED).alias("least"), F.lit(True).alias("acts"), F.lit("lists").alias("kind"))
    mentions = materialize(reduce(DataFrame.unionByName, [cited, objects, listed]).join(holders, "no_key", "left").distinct())
    named = mentions.filter("holder is not null").withColumn("dst", F.col("holder")).withColumn("score", F.lit(None).cast("int"))
    named = named.unionByName(best_titles(mentions.filter("holder is null"), facts.select("doc_id", "key")))
    numbers_of = facts.select(F.col("doc_id").alias("dst"), "number")
    named = materialize(named.join(numbers_of, "dst", "left"))

    sure = F.when(F.col("dst").isNotNull(), "high")
    by_title = _rows(named.filter("kind = 'cites'"), "cites", "content", F.col("dst"), F.coalesce("number", "said"), F.concat(F.lit("cites 《"), "said", F.lit("》")), sure.otherwise("low"))
    refs = facts.select(src, "own_no", F.explode("numbers").alias("no_key")).filter("own_no is null or own_no != no_key").join(holders, "no_key", "left")
    by_number = _rows(refs, "cites", "content", F.col("holder"), F.col("no_key"), F.concat(F.lit("cites "), "no_key"), F.lit("medium"))
    repeals = _rows(named.filter("kind = 'repeals'"), "repeals", "content", F.col("dst"), F.when(F.col("holder").isNotNull(), F.col("said")).otherwise(F.coalesce("number", "said")), F.concat(F.lit("repeals "), "said"), sure.otherwise("low"))
    catalogs = _rows(named.filter("kind = 'lists'"), "repeals", "official_catalog", F.col("dst"), F.col("said"), F.concat(F.lit("listed "), "said"), sure.otherwise("medium"))
    selves = _rows(facts.filter("own_repeal is not null").select(src, "own_repeal"), "self_repealed", "content_self", F.lit(None), none, F.col("own_repeal"), F.lit("high"))
    every = reduce(DataFrame.unionByName, [by_title, by_number, repeals, catalogs, selves])
    if held is not None:
        every = every.unionByName(held.select(*_COLUMNS).filter("evidence_source IN ('manual', 'official_catalog')"))
    rank = F.when(F.col("evidence_source") == "manual", 0).when(F.col("evidence_source") == "official_catalog", 1).otherwise(2)
    order = Window.partitionBy("src", "relation", "dst", "dst_no").orderBy(rank, "evidence", "confidence")
    out = materialize(every.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth"))
    discard(facts, mentions, named)
    return out


def judge(docs: DataFrame, relations: DataFrame, as_of: str) -> DataFrame:
    """(doc_id, status, source, reason, needs_review) of each row of docs (doc_id, aging, effective) from the whole relation
    table: a catalogue's listing, else the official note, else own words, else another document's, else a day to come,
    else valid by default, which is never called official. Inferred repeals are for review. Unknown notes are no notes.
    """
    flag = lambda rows, key, name: rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.min("evidence").alias(name))
    repeals = relations.filter("relation = 'repeals'")
    listed = flag(repeals.filter("evidence_source = 'official_catalog'"), "dst", "listed")
    another, own = flag(repeals, "dst", "another"), flag(relations.filter("relation = 'self_repealed'"), "src", "own")
    found = docs.select("doc_id", "aging", "effective").join(listed, "doc_id", "left").join(own, "doc_id", "left").join(another, "doc_id", "left")
    noted = F.col("aging").isin("现行有效", "已废止", "部分失效", "尚未生效")
    later = F.col("effective") > F.lit(as_of).cast("date")
    pick = lambda *v: F.when(F.col("listed").isNotNull(), v[0]).when(noted, v[1]).when(F.col("own").isNotNull(), v[2]).when(F.col("another").isNotNull(), v[3]).when(later, v[4]).otherwise(v[5])
    status = pick(F.lit("已废止"), F.col("aging"), F.lit("已废止"), F.lit("已废止"), F.lit("尚未生效"), F.lit("现行有效"))
    source = pick(*map(F.lit, ("official", "official", "inferred", "inferred", "inferred", "default")))
    reason = pick(F.col("listed"), F.col("aging"), F.col("own"), F.col("another"), F.col("effective").cast("string"), F.lit("no evidence of repeal"))
    return found.select("doc_id", status.alias("status"), source.alias("source"), reason.alias("reason"), ((source == "inferred") & (status == "已废止")).alias("needs_review"))


def repeal_closure(relations: DataFrame, most: int = 60) -> DataFrame:
    """(src, dst, steps): every document that repeals another, directly or through others, with the fewest steps.

    Paths are doubled each round: those of up to n steps are joined end to end with themselves, so chains of n documents
    take log n rounds. Each pair is kept once, with its least steps, so circles end; a document that repeals itself in a
    circle is a pair with itself. Two numbers a round reach the driver.
    """
    now = materialize(relations.filter("relation = 'repeals' and dst is not null").select("src", "dst").distinct().withColumn("steps", F.lit(1)))
    mark = F.struct(F.count("*").alias("n"), F.sum(F.col("steps").cast("long")).alias("steps"))
    seen = now.agg(mark.alias("m")).first()["m"]
    for _ in range(most if seen["n"] else 0):
        on = now.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("steps").alias("more"))
        longer = now.join(on, "dst").select("src", F.col("end").alias("dst"), (F.col("steps") + F.col("more")).alias("steps"))
        nxt = materialize(now.unionByName(longer).groupBy("src", "dst").agg(F.min("steps").alias("steps")))
        mark_now = nxt.agg(mark.alias("m")).first()["m"]
        discard(now)
        now = nxt
        if mark_now == seen:
            return now
        seen = mark_now
    if seen["n"]:
        raise RuntimeError(f"closure did not settle in {most} rounds")
    return now
