"""Queries of the core operators over the shared tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.operators import change, documents, keep, labels, layout, match, pages, reconcile, rows, scoring, sequence
from cadastra.session import table

#: A small table of factors by life and year, and keywords in their order (fixed values).
FACTORS = [(5, 1996, 0.15), (5, 1997, 0.2), (5, 1998, 0.45), (5, 1999, 0.75), (8, 1995, 0.05), (8, 1996, 0.1), (8, 1997, 0.2), (8, 1999, 0.6), (9, 1997, 0.1), (9, 1998, 0.5), (9, 2000, 0.9)]
KEYWORDS = [("ring", 5), ("small", 9), ("widget", 8), ("bolt", 6), ("large", 4)]
ANCHORS = [("upper left", 5.0, 10.0), ("upper middle", 25.0, 10.0), ("upper right", 45.0, 10.0), ("lower left", 5.0, 80.0), ("lower middle", 25.0, 80.0), ("lower right", 45.0, 80.0)]
WORKSHEET = [0.8, 0.65, 0.5, 0.3, 0.1]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def money_parse(spark, d):
    """Amounts read back from texts written in several ways: signs, brackets, misread zeros, split and stray digits, other separators."""
    items = _t(spark, d, "lineitem").withColumn("shown", F.format_number("l_extendedprice", 2))
    n = F.col("l_linenumber") % 7
    split = F.regexp_replace("shown", r"^1(?=\d{2},)", "1 ")
    written = (
        F.when(n == 0, F.concat(F.lit("$ "), "shown")).when(n == 1, F.translate("shown", "0", "O")).when(n == 2, F.concat(F.lit("("), "shown", F.lit(")")))
        .when((n == 3) & F.col("shown").rlike(r"^\d{2,3},"), F.concat(F.lit("6 "), "shown")).when(n == 4, split).when(n == 5, F.regexp_replace(F.translate("shown", ",", ""), r"\.", ",")).otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    )
    return items.select("l_orderkey", "l_linenumber", "l_partkey", F.round(text.money(written), 2).alias("amount"))


def amounts_in_text(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", text.amounts(F.col("text")).alias("a")).where(F.size("a") > 0)
    return docs.select("doc_id", F.size("a").cast("bigint").alias("amounts"), F.round(F.array_max("a"), 2).alias("largest"))


def years_in_text(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.explode(text.years(F.col("text"))).alias("year"))
    return docs.groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))


def evidence_snippets(spark, d):
    """Every TOTAL in the documents with its place and the text around it."""
    docs = _t(spark, d, "documents").select("doc_id", "text", F.explode(text.spans(F.col("text"), "TOTAL")).alias("s"))
    return docs.select("doc_id", F.col("s.start").cast("bigint").alias("place"), text.evidence(F.col("text"), F.col("s.start"), F.col("s.end")).alias("snippet"))


def year_places(spark, d):
    """Every year in the documents with the place it stands at."""
    docs = _t(spark, d, "documents").select("doc_id", F.explode(text.year_spans(F.col("text"))).alias("s"))
    return docs.select("doc_id", F.col("s.start").cast("bigint").alias("place"), F.col("s.value").cast("bigint").alias("year"))


def money_places(spark, d):
    """Every plausible amount in the documents with the place it stands at."""
    docs = _t(spark, d, "documents").select("doc_id", F.explode(text.money_spans(F.col("text"))).alias("s"))
    return docs.select("doc_id", F.col("s.start").cast("bigint").alias("place"), F.col("s.raw").alias("raw"), F.col("s.value").alias("amount"))


#: Labels of the fields that are looked for beside amounts and years, with their base confidence.
LABELS = {"cost": (["historical cost", "original cost", "total cost"], 0.7), "value": (["good faith", "market value"], 0.72), "total": (["grand total", "total"], 0.6)}
YEAR_LABELS = {"acquired": (["year acquired", "acquired"], 0.68), "tax_year": (["tax year", "rendition"], 0.6)}


def label_candidates(spark, d):
    """The best amount or year beside the labels of each field in each document."""
    return labels.candidates(_t(spark, d, "documents"), ["doc_id"], "text", LABELS, YEAR_LABELS)


def candidate_lines(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.size(text.candidate_lines(F.coalesce("text", F.lit("")))).cast("bigint").alias("candidate_lines"))


def document_fields(spark, d):
    """The best candidate of each field of each document, by the kind of its page."""
    return documents.resolved(_pages(spark, d), ["doc_id"], "page_number", "text")


def context_candidates(spark, d):
    """Every amount and acquisition year of the documents with the label that the words around it suggest."""
    return documents.context_candidates(_pages(spark, d), ["doc_id"], "page_number", "text").drop("evidence")


def document_items(spark, d):
    """Line items of the documents, by their lines and by the places of their words."""
    boxed = _pages(spark, d).select("doc_id", "page_number", "text").join(_word_pages(spark, d), "doc_id", "left")
    return documents.line_items(boxed, ["doc_id"], "page_number", "doc_id", "text", "words")


def page_one_flags(spark, d):
    """What each document shows of the first page of a form."""
    docs = _t(spark, d, "documents").select("doc_id", text.form_flags(F.col("text")).alias("f"))
    return docs.select("doc_id", "f.*")


def schedule_values(spark, d):
    """Amounts with a dollar sign in the schedules of each district's documents."""
    docs = _t(spark, d, "documents").where("district_id IS NOT NULL")
    found = rows.schedule_values(docs, ["district_id"], "doc_id", "text")
    return found.select("district_id", "letter", F.size("pages").cast("bigint").alias("pages"), F.size("amounts").cast("bigint").alias("amounts"), "largest")


def value_guardrail(spark, d):
    """Summaries whose recommended value none of the queue's rows of their account has."""
    queue = _t(spark, d, "review_queue").where("account_number IS NOT NULL").select("account_number", F.col("recommended_value").alias("candidate"))
    items = _t(spark, d, "sample_rendition_summary").select("summary_id", "account_number", "recommended_value")
    return match.allowed(items, queue, "account_number", "recommended_value", "candidate").select("summary_id", "recommended_value", "rejected")


def trust_of_rows(spark, d):
    """The trust of each row's status by a stated table, unknown ones as the lowest."""
    states = {"ready": 30, "locked": 60, "accepted": 50, "unknown": 0}
    rows_ = _t(spark, d, "review_queue").withColumn("state", text.state_key(F.col("status")))
    found = match.mapped(rows_, "state", states, "trust", "unknown", "unmapped")
    return found.groupBy("trust", "unmapped").agg(F.count("*").alias("rows")).select(F.col("trust").cast("bigint").alias("trust"), "unmapped", "rows")


def owners_resolved(spark, d):
    """Customers resolved to suppliers by number, else by name without case."""
    members = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("member"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey") * 2).alias("person"), F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")).alias("mail"))
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.upper("c_name").alias("mail"))
    return match.resolve_members(people, members, "member", "person", "mail").select("person", "member", "backfill")


def stamped_upsert(spark, d):
    """Districts with changed names stamped, others as they were."""
    base = _t(spark, d, "districts").select("id", "name", "updated_at")
    updates = base.select("id", F.when(F.col("name") == F.upper("name"), F.initcap("name")).otherwise(F.col("name")).alias("name"), F.lit(None).cast("timestamp").alias("updated_at"))
    out = change.upsert_stamped(base, updates, "id", "updated_at", F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return out.select("id", F.length("name").cast("bigint").alias("letters"), (F.year("updated_at") == 2030).alias("changed"))


def kinds_by_like(spark, d):
    """Files by the pattern of their name."""
    kind = text.by_like(F.col("file_name"), [("%.pdf", "pdf"), ("%.tif%", "scan"), ("rendition%", "rendition")], "other")
    return _t(spark, d, "review_queue").groupBy(kind.alias("kind")).agg(F.count("*").alias("rows"))


def union_of_schedules(spark, d):
    """Orders and lines as one list of items, columns that one of them lacks NULL."""
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    items = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("quantity"))
    return reconcile.union_all([orders, items], "source").groupBy(F.col("source").cast("bigint").alias("source")).agg(F.count("price").alias("prices"), F.count("quantity").alias("quantities"), F.count("*").alias("rows"))


def confidence_labels(spark, d):
    """Mean confidence of the agents by district, as a label."""
    return scoring.mean_confidence(_t(spark, d, "sample_rendition_summary"), ["district_id"], "agent_confidence")


def document_metadata(spark, d):
    """Tax year, owner, account and date from the head of each document."""
    return pages.metadata(_pages(spark, d), ["doc_id"], "page_number", "text")


def _pages(spark, d):
    """Each document as a page of its own file."""
    return _t(spark, d, "documents").withColumn("page_number", F.lit(1))


def document_quality(spark, d):
    """How much of a whole declaration each document shows."""
    q = _t(spark, d, "documents").select("doc_id", pages.quality(F.col("text"), F.lit(1)).alias("q"))
    return q.select("doc_id", "q.score", "q.usable", F.array_join("q.missing_schedules", ",").alias("missing_schedules"), F.array_join("q.missing_columns", ",").alias("missing_columns"), "q.columns_unreadable")


def reading_need(spark, d):
    """Why documents should be read by recognition."""
    return pages.needs_reading(_pages(spark, d), ["doc_id"], "page_number", "text").select("doc_id", "characters", "digits", "terms", "reason")


def page_flags(spark, d):
    """What is wrong with the pages of each district."""
    docs = _t(spark, d, "documents").where("district_id IS NOT NULL").withColumn("error", F.when(F.col("text") == "", F.concat(F.lit("empty "), "doc_kind"))).withColumn("gone", F.col("text").isNull())
    return pages.flags(docs, ["district_id"], "text", "error", "gone").withColumn("errors", F.array_join("errors", "|"))


def provider_summary(spark, d):
    """Pages and characters that each source gave for each district."""
    docs = _t(spark, d, "documents").where("district_id IS NOT NULL AND source IS NOT NULL")
    return pages.by_provider(docs, ["district_id"], "source", "doc_id", "text", "doc_kind")


def merged_readings(spark, d):
    """The longer text of two sources for each district and tax year."""
    docs = _t(spark, d, "documents").where("district_id IS NOT NULL AND tax_year IS NOT NULL").withColumn("words", F.array().cast(layout.WORDS)).withColumn("error", F.when(F.col("text") == "", "empty"))
    merged = pages.merge_readings(docs.where("source = 'scan_batch'"), docs.where("source = 'mail_room'"), ["district_id", "tax_year"], ("scan_batch", "mail_room"))
    return merged.select("district_id", F.col("tax_year").cast("bigint").alias("tax_year"), F.length("text").cast("bigint").alias("characters"), F.md5("text").alias("text_md5"), "preferred", F.array_join("sources", "|").alias("sources"))


def section_rows(spark, d):
    """Line items in the text of the schedules' sections."""
    found = rows.schedule_rows(_t(spark, d, "documents"), ["doc_id"], "text")
    return found.drop("money_tokens", "year_tokens")


def section_totals(spark, d):
    """Totals of the documents with a Schedule E, and of attachments."""
    docs = _t(spark, d, "documents").select("doc_id", rows.section_total(F.col("text")).alias("s"), rows.attachment_summary(F.col("text")).alias("a"))
    return docs.select("doc_id", F.col("s.present").alias("section"), F.col("s.total").alias("section_total"), F.col("a.present").alias("summary"), F.size("a.amounts").cast("bigint").alias("amounts"), F.col("a.total").alias("summary_total"))


def repaired_text(spark, d):
    """Documents with their usual misreadings mended, in either case."""
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(text.mended_lower(F.col("text"))).alias("lower_md5"), F.md5(text.mended_upper(F.col("text"))).alias("upper_md5"))


def wrapped_notes(spark, d):
    """The appraisers' notes in lines of 48 characters."""
    notes = _t(spark, d, "sample_rendition_summary").where("appraiser_notes IS NOT NULL")
    return notes.select("summary_id", F.posexplode(text.wrapped(F.col("appraiser_notes"))).alias("line", "body"))


def file_stems(spark, d):
    return _t(spark, d, "review_queue").select("queue_id", text.safe_stem(F.col("file_name")).alias("stem"), text.safe_account(F.col("account_number")).alias("account"))


def district_slugs(spark, d):
    return _t(spark, d, "districts").select("id", text.district_slug(F.col("name")).alias("made_slug"), (text.district_slug(F.col("name")) == F.col("slug")).alias("as_stored"))


def tax_years(spark, d):
    return _t(spark, d, "review_queue").groupBy(text.tax_year(F.col("tax_year")).cast("bigint").alias("year")).agg(F.count("*").alias("rows"))


def status_counts(spark, d):
    return _t(spark, d, "review_queue").groupBy(text.state_key(F.col("status")).alias("status_key")).agg(F.count("*").alias("rows"), F.round(F.sum("recommended_value"), 2).alias("value"))


def email_domains(spark, d):
    """Email addresses in the documents by their domains, joined to the districts that own them."""
    mails = _t(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+"), F.lit(0))).alias("mail"))
    domains = mails.groupBy(text.email_domain(F.col("mail")).alias("domain_read")).agg(F.count("*").alias("mails"))
    districts = _t(spark, d, "districts").where("domain IS NOT NULL").groupBy(F.lower("domain").alias("domain_read")).agg(F.min("slug").alias("slug"))
    return domains.join(districts, "domain_read", "full_outer").select("domain_read", F.coalesce("mails", F.lit(0)).alias("mails"), "slug")


def queue_latest(spark, d):
    """The latest row of each file and district by its place in the queue."""
    rows = _t(spark, d, "review_queue").where("file_name IS NOT NULL").select("district_id", "file_name", "queue_id", "recommended_value")
    return keep.best_of(rows, ["district_id", "file_name"], F.struct("queue_id"))


def newest_event(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return keep.best_of(events, ["user_id"], F.struct("at", "event_id")).select("user_id", "event_id", "event_type")


def top_orders(spark, d):
    orders = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return keep.top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).withColumn("rank", F.col("rank").cast("bigint"))


def conflict_flag(spark, d):
    orders = _t(spark, d, "orders")
    return keep.conflict(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_orderpriority")


def dedupe_items(spark, d):
    """Equal items once: the dearest, then the first line, from two overlapping sources."""
    items = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    both = items.unionByName(items.where("l_linenumber <= 2"))
    rank = F.struct(F.col("l_extendedprice"), (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"))
    return keep.best_of(both, ["l_partkey", "l_suppkey"], rank)


def schedule_totals(spark, d):
    items = _t(spark, d, "lineitem").withColumn("letter", F.concat("l_returnflag", "l_linestatus"))
    return keep.zero_filled_pivot(items, ["l_suppkey"], "letter", ["AF", "NO", "RF", "NF"], F.col("l_quantity"))


def floor_factors(spark, d):
    """The factor of each order's life and year, the oldest before the table begins, none in its gaps."""
    factors = spark.createDataFrame(FACTORS, "life BIGINT, year BIGINT, factor DOUBLE")
    lives = F.element_at(F.array(F.lit(5), F.lit(8), F.lit(9)), (F.col("o_orderkey") % 3 + 1).cast("int")).cast("bigint")
    orders = _t(spark, d, "orders").select("o_orderkey", lives.alias("life"), F.year("o_orderdate").cast("bigint").alias("year"))
    return match.floor_lookup(orders, F.broadcast(factors), "life", "year", "factor").select("o_orderkey", "life", "year", "factor")


def keyword_class(spark, d):
    parts = match.first_keyword(_t(spark, d, "part"), "p_name", KEYWORDS, "life")
    return parts.select("p_partkey", F.col("life").cast("bigint").alias("life"))


def priority_match(spark, d):
    """Each order's segment by customer, else by supplier of the same number, else by nation."""
    customers = _t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.lit(None).cast("bigint").alias("k2"), F.col("c_mktsegment").alias("found"))
    suppliers = _t(spark, d, "supplier").select(F.lit(None).cast("bigint").alias("c_custkey"), F.col("s_suppkey").alias("k2"), F.col("s_name").alias("found"))
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = match.by_priority(orders, customers.unionByName(suppliers), [(F.col("o_custkey"), "c_custkey"), (F.col("o_custkey"), "k2")], "found")
    return joined.select("o_orderkey", "found")


def label_band(spark, d):
    """For each returned line the nearest other amount within the band of its order."""
    items = _t(spark, d, "lineitem").withColumn("at", (F.col("l_linenumber") * 40 + F.col("l_partkey") % 40).cast("bigint"))
    labels = items.where("l_returnflag = 'R'").select("l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey").alias("label_id"), F.col("at").alias("label_at")).distinct()
    values = items.where("l_returnflag <> 'R'").select("l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey").alias("value_id"), F.col("at").alias("value_at"))
    return match.nearest_in_band(labels, values, "l_orderkey", 40, 120)


def nearest_region(spark, d):
    points = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 97).cast("double").alias("y"))
    return match.nearest_anchor(points, ANCHORS, F.col("x"), F.col("y"), "region").select("p_partkey", "region", F.round("cost", 4).alias("cost"))


def full_outer_merge(spark, d):
    left = _t(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k"), F.col("c_name").alias("shown"))
    right = _t(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.concat("s_name", F.when(F.col("s_acctbal") > 0, F.lit(" in credit")).otherwise("")).alias("shown"))
    return match.longer_of(left, right, "k", "shown")


def provider_reconcile(spark, d):
    """Three readings of each order's price, compared."""
    orders = _t(spark, d, "orders")
    p = F.col("o_totalprice")
    readings = F.array(p, F.when(F.col("o_orderkey") % 2 == 0, p + 0.5), F.when(F.col("o_orderkey") % 5 == 0, p + 7))
    return reconcile.agreement(orders.select("o_orderkey", F.explode(readings).alias("value")), ["o_orderkey"], "value")


def provider_priority(spark, d):
    """Of each district and tax year the text of the best ranked source that has any."""
    docs = _t(spark, d, "documents").where("district_id IS NOT NULL AND tax_year IS NOT NULL").select("district_id", "tax_year", "source", "text")
    best = reconcile.first_with_text(docs, ["district_id", "tax_year"], "source", {"scan_batch": 0, "mail_room": 1, "district_site": 2}, "text")
    return best.select("district_id", F.col("tax_year").cast("bigint").alias("tax_year"), "source", F.md5("text").alias("text_md5"))


def union_of_candidates(spark, d):
    customers = _t(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_name").alias("who"))
    suppliers = _t(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_name").alias("who"))
    return reconcile.union_distinct(suppliers, customers, [F.col("nation")], ["who"])


def flag_union(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, F.lit("deep_discount")), F.when(F.col("l_quantity") < 3, F.lit("tiny")), F.when(F.col("l_tax") == 0, F.lit("untaxed"))))
    united = reconcile.flag_union(_t(spark, d, "lineitem").select("l_suppkey", flags.alias("flags")), ["l_suppkey"], "flags")
    return united.select("l_suppkey", F.array_join("flags", "|").alias("flags"))


def carry_forward(spark, d):
    """Errors after a purchase take its kind, along whole runs."""
    events = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return sequence.carry_forward(events, "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "error", "purchase", "carried").select("event_id", "carried")


def schedule_headings(spark, d):
    return sequence.headings(_t(spark, d, "documents"), "doc_id", "text", r"\bSCHEDULE\s+([A-F])\b")


def schedule_sections(spark, d):
    cut = sequence.sections(_t(spark, d, "documents"), "doc_id", "text")
    return cut.select("doc_id", "pos", "letter", F.size(F.split("body", "\n")).cast("bigint").alias("lines"), F.md5("body").alias("body_md5"))


def last_sections(spark, d):
    """The last section of each letter."""
    return sequence.sections(_t(spark, d, "documents"), "doc_id", "text", last_only=True).select("doc_id", "letter", "pos")


def gap_segments(spark, d):
    events = _t(spark, d, "events").select("user_id", "ts", "event_id")
    cut = sequence.gap_segments(events, "user_id", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 1800.0, "segment")
    return cut.groupBy("user_id").agg(F.max("segment").alias("segments"), F.count("*").alias("events"))


def worksheet_rows(spark, d):
    base = _t(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("year")).distinct()
    return sequence.offset_rows(base, "year", WORKSHEET)


def page_types(spark, d):
    scored = scoring.classify(_t(spark, d, "documents"), F.col("text"))
    return scored.groupBy("doc_kind", "page_type").agg(F.count("*").alias("pages"), F.round(F.sum("score"), 2).alias("score"))


def page_type_of(spark, d):
    return scoring.classify(_t(spark, d, "documents"), F.col("text")).select("doc_id", "page_type", "score")


def text_quality(spark, d):
    docs = _t(spark, d, "documents").where(F.col("text").isNotNull())
    return scoring.character_profile(docs, "text").select("doc_id", "letters", "digits", "blanks", "letter_share", "digit_share")


def best_candidate(spark, d):
    orders = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    confidence = (F.col("o_orderkey") % 7) / 10.0
    boost, penalty = F.when(F.col("o_orderpriority") == "1-URGENT", 0.2).otherwise(0.0), F.when(F.col("o_orderstatus") == "F", 0.1).otherwise(0.0)
    return scoring.best_candidate(orders, ["o_custkey"], confidence, boost, penalty, "o_orderkey").select("o_custkey", "o_orderkey", "score")


def upsert_customers(spark, d):
    base = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("who"), F.col("c_acctbal").alias("balance"))
    updates = _t(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("k"), F.col("s_name").alias("who"), F.col("s_acctbal").alias("balance"))
    return change.upsert(base, updates, "k")


def fill_districts(spark, d):
    queue = _t(spark, d, "review_queue").select("queue_id", F.col("district_id").alias("id"), F.col("district_slug").alias("slug"))
    known = _t(spark, d, "districts").select("id", "slug")
    return change.fill_from(queue, known, "id", ["slug"]).select("queue_id", "id", "slug")


def append_new_customers(spark, d):
    """Customers with a balance, and of the suppliers with numbers above theirs those that are new."""
    old = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("who"))
    new = _t(spark, d, "supplier").select((F.col("s_suppkey") * 5).alias("k"), F.col("s_name").alias("who"))
    return change.append_new(old, new, "k")


def without_orders(spark, d):
    """Customers without an urgent order."""
    urgent = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return change.delete_where_in(_t(spark, d, "customer").select("c_custkey", "c_name"), urgent, "c_custkey")


def with_orders(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def rule_violations(spark, d):
    rules = {"value_missing": F.col("recommended_value").isNotNull(), "account_missing": F.trim("account_number") != "", "owner_missing": F.trim("owner_name") != ""}
    return change.violations(_t(spark, d, "review_queue"), rules).groupBy("rule").agg(F.count("*").alias("rows"))


def duplicate_files(spark, d):
    return change.duplicate_keys(_t(spark, d, "review_queue").where("file_name IS NOT NULL"), ["file_name"]).select("file_name", "rows")


def tenant_rank(spark, d):
    """Customers of a nation in order of balance, missing ones last."""
    balance = F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal"))
    rows = _t(spark, d, "customer").select("c_nationkey", "c_custkey", balance.alias("balance"))
    return keep.top_k(rows, ["c_nationkey"], [F.asc_nulls_last("balance"), F.asc("c_custkey")], 5).select(F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_custkey", F.col("rank").cast("bigint").alias("rank"))


def event_properties(spark, d):
    props = _t(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return props.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("largest"))


def district_profile(spark, d):
    queue = _t(spark, d, "review_queue").groupBy("district_id").agg(F.count("*").alias("rows"), F.round(F.sum("recommended_value"), 2).alias("value"))
    return _t(spark, d, "districts").select("id", "slug").join(queue, F.col("id") == F.col("district_id")).select("slug", "rows", "value")


def order_revenue(spark, d):
    """Revenue by nation: filters and columns pushed into the scans, small tables broadcast by their size."""
    items = _t(spark, d, "lineitem").where("l_discount > 0.02").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    nations = _t(spark, d, "nation")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def _word_pages(spark, d):
    """Word boxes laid out from the documents' lines."""
    return layout.words_of_lines(_t(spark, d, "documents"), "doc_id", "text")


def year_amount_pairs(spark, d):
    """Years and amounts that stand side by side, from laid-out word boxes."""
    return layout.page_pairs(_t(spark, d, "documents"), "doc_id", "text")


def subsection_rows(spark, d):
    """Rows of the subsections by their places on the page."""
    return layout.page_subsection_rows(_t(spark, d, "documents"), "doc_id", "text")


def subsection_totals(spark, d):
    """Totals of the subsections by their places on the page."""
    return layout.page_subsection_totals(_t(spark, d, "documents"), "doc_id", "text")


def subsection_headings(spark, d):
    """Places of the subsections' headings."""
    return layout.page_headings(_word_pages(spark, d), "doc_id", "words")


def windowed_events(spark, d):
    from cadastra.streaming.queue import windowed_counts

    counts = windowed_counts(_t(spark, d, "events"), "ts", "event_type", "1 hour")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


_NAMES = (
    money_parse, amounts_in_text, years_in_text, evidence_snippets, candidate_lines, district_slugs, tax_years, status_counts, email_domains, queue_latest, newest_event, top_orders, conflict_flag, dedupe_items, schedule_totals,
    floor_factors, keyword_class, priority_match, label_band, nearest_region, full_outer_merge, provider_reconcile, provider_priority, union_of_candidates, flag_union, carry_forward, schedule_headings, schedule_sections, gap_segments,
    worksheet_rows, page_types, page_type_of, text_quality, best_candidate, upsert_customers, fill_districts, append_new_customers, without_orders, with_orders, rule_violations, duplicate_files, tenant_rank, event_properties,
    district_profile, order_revenue, year_amount_pairs, windowed_events, year_places, money_places, label_candidates, document_metadata, document_quality, reading_need, page_flags, provider_summary, merged_readings, section_rows,
    section_totals, document_fields, context_candidates, document_items, page_one_flags, schedule_values, value_guardrail, trust_of_rows, owners_resolved, stamped_upsert, kinds_by_like, union_of_schedules, confidence_labels, repaired_text, wrapped_notes, file_stems, last_sections, subsection_rows, subsection_totals, subsection_headings,
)


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


def _scores(terms: dict[str, float]) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN {v} ELSE 0 END" for w, v in terms.items())


def _mended_sql(column: str, repairs: dict[str, str]) -> str:
    for bad, good in repairs.items():
        column = f"replace({column}, '{bad}', '{good}')"
    return column


_SPACE = r"[\s\x00\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_COLLAPSED = rf"trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))"


def _page_sql() -> str:
    kinds = list(scoring.PAGE_TERMS)
    pairs = " + ".join(f"CASE WHEN contains(t, '{a}') AND contains(t, '{b}') THEN {w} ELSE 0 END" for (a, b), w in scoring.SCHEDULE_PAIRS.items())
    table = f"CASE WHEN n > {scoring.LONG} THEN {scoring.LONG_ADDS} ELSE 0 END + CASE WHEN marks / greatest(n, 1) > {scoring.MARKS_SHARE} THEN {scoring.MARKS_ADD} ELSE 0 END + CASE WHEN digits / greatest(n, 1) > {scoring.DIGITS_SHARE} THEN {scoring.DIGITS_ADD} ELSE 0 END + CASE WHEN letters > {scoring.MANY_LETTERS} AND marks > {scoring.MANY_MARKS} THEN {scoring.MANY_ADD} ELSE 0 END"
    columns = ", ".join(f"round(CAST({_scores(scoring.PAGE_TERMS[k])}{f' + ({pairs}) + ({table})' if k == 'schedule' else ''} AS DOUBLE), 3) AS {k}" for k in kinds)
    best = f"greatest({', '.join(kinds)})"
    pick = " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in kinds)
    count = lambda cls: f"(length(flat) - length(regexp_replace(flat, '{cls}', '', 'g')))"
    read = f"SELECT doc_id, doc_kind, flat, {_mended_sql('lower(flat)', text.LOWER_REPAIRS)} AS t, length(flat) AS n, {count(chr(92) + 'p{L}')} AS letters, {count(chr(92) + 'p{Nd}')} AS digits, {count('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]')} AS marks FROM (SELECT doc_id, doc_kind, coalesce({_COLLAPSED}, '') AS flat FROM documents)"
    return f"SELECT doc_id, doc_kind, CAST({best} AS DOUBLE) AS score, CASE WHEN {best} < {scoring.LEAST_SCORE} THEN 'unknown' ELSE CASE {pick} END END AS page_type FROM (SELECT doc_id, doc_kind, {columns} FROM ({read}))"


def _places_sql(pattern: str, columns: str) -> str:
    """Every match of a pattern with its place ``found_at`` from 0 and ``hit``: what stands before it, summed."""
    found = f"SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents WHERE text IS NOT NULL"
    numbered = f"SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({found})"
    return f"SELECT {columns} FROM (SELECT doc_id, text, m[i] AS hit, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS found_at FROM ({numbered}))"


def _upper_sql() -> str:
    blank = r"[ \t\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return f"regexp_replace({_mended_sql("upper(coalesce(text, ''))", text.UPPER_REPAIRS)}, '{blank}+', ' ', 'g')"


#: Steps from a written amount ``x`` to its value, as SQL over a relation of the same further columns.
_STEPS = (
    r"translate(regexp_replace(x, '^[($)\s]+|[($)\s]+$', '', 'g'), 'Oo$', '00')",
    r"regexp_replace(regexp_replace(x, '(^|\s)[2-9]\s+(\d{2,3},\d{3}(?:\.\d{1,2})?)(\D|$)', '\1\2\3', 'g'), '\s+', '', 'g')",
    r"CASE WHEN contains(x, ',') AND NOT contains(x, '.') AND NOT regexp_full_match(x, '\d{1,3}(,\d{3})+') THEN replace(x, ',', '.') WHEN NOT contains(x, ',') AND length(x) - length(replace(x, '.', '')) > 1 THEN replace(x, '.', '') ELSE replace(x, ',', '') END",
)


def _valued_sql(relation: str, columns: str) -> str:
    """``relation`` (columns, x) with the value ``v`` of the amount written in ``x``."""
    for step in _STEPS:
        relation = f"SELECT {columns}, {step} AS x FROM ({relation})"
    return f"SELECT {columns}, " + r"CASE WHEN regexp_full_match(x, '-?(\d+\.?\d*|\.\d+)') THEN CAST(x AS DOUBLE) END AS v" + f" FROM ({relation})"


def _rows_sql() -> str:
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    mark = " ".join(f"WHEN {' OR '.join(f"contains(lower(line), '{p}')" for p in phrases)} THEN '{name}'" for name, phrases in rows.PHRASES.items())
    confidence = " ".join(f"WHEN '{letter}' THEN {c}" for letter, c in rows.CONFIDENCE.items())
    bare = f"contains(compact, ' ') AND NOT regexp_matches(compact, '[,.]') AND len(regexp_extract_all(compact, '\\d{{3,4}}')) >= 2 AND len(list_filter(regexp_extract_all(compact, '\\d{{3,4}}'), lambda g: regexp_matches(g, '^{text.YEAR_IN_TEXT}$'))) > 0"
    tokens = f"SELECT doc_id, letter, pos, k, trim(replace(r, '$', '')) AS compact, trim(r) AS x FROM (SELECT doc_id, letter, pos, rs[k] AS r, k FROM (SELECT *, unnest(range(1, len(rs) + 1)) AS k FROM (SELECT doc_id, letter, pos, regexp_extract_all(line, '{text.MONEY_TOKEN}') AS rs FROM marked)))"
    return (
        r"WITH h AS (SELECT doc_id, regexp_extract_all(text, '(?i)\bSCHEDULE\s+([A-F])\b', 1) AS h, string_split_regex(text, '(?i)\bSCHEDULE\s+[A-F]\b') AS g FROM documents WHERE text IS NOT NULL), "
        r"s AS (SELECT doc_id, upper(h[i]) AS letter, regexp_replace(g[i + 1], '^\s*|\s+$', '', 'g') AS body FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM h) QUALIFY row_number() OVER (PARTITION BY doc_id, upper(h[i]) ORDER BY i DESC) = 1), "
        f"l AS (SELECT doc_id, letter, i, trim(regexp_replace(ls[i], '{_SPACE}+', ' ', 'g')) AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, letter, string_split_regex(body, '{breaks}') AS ls FROM s WHERE letter <> 'F'))), "
        f"marked AS (SELECT doc_id, letter, line, row_number() OVER w AS pos, last_value(CASE {mark} END IGNORE NULLS) OVER w AS running FROM l WHERE length(line) >= 4 AND NOT regexp_matches(upper(line), '^SCHEDULE |TOTAL|{'|'.join(text.HEAD_WORDS)}') WINDOW w AS (PARTITION BY doc_id, letter ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
        f"v AS ({_valued_sql(tokens, 'doc_id, letter, pos, k, compact')}), "
        f"t AS (SELECT doc_id, letter, pos, list(v ORDER BY k) AS vs FROM v WHERE v >= 100 AND NOT (v = floor(v) AND v BETWEEN 1900 AND 2100) AND NOT ({bare}) GROUP BY 1, 2, 3), "
        f"r AS (SELECT m.*, vs, len(vs) AS n, CAST(list_last(regexp_extract_all(line, '{text.YEAR_IN_TEXT}')) AS INTEGER) AS y FROM marked m JOIN t USING (doc_id, letter, pos) WHERE letter <> 'E' OR running IS NOT NULL) "
        "SELECT doc_id, letter AS schedule, CAST(pos AS BIGINT) AS pos, CASE WHEN letter = 'E' THEN running END AS subsection, CASE WHEN letter NOT IN ('B', 'C') THEN y END AS year_acquired, "
        "CASE WHEN letter IN ('A', 'D') AND (y IS NOT NULL OR n >= 2) THEN vs[n] WHEN letter = 'E' AND y IS NOT NULL THEN vs[1] END AS historical_cost, "
        "CASE WHEN letter IN ('A', 'D') THEN CASE WHEN n >= 2 THEN vs[n - 1] WHEN y IS NULL THEN vs[1] END WHEN letter = 'E' AND (n >= 2 OR y IS NULL) THEN vs[n] END AS good_faith_value, "
        f"CASE WHEN letter IN ('B', 'C') THEN vs[n] END AS exact_value, line AS raw_text, CAST(CASE letter {confidence} END AS DOUBLE) AS confidence FROM r"
    )


def _pairs_sql() -> str:
    """Words of one line have one height here, so a line is a band."""
    token = f"[^{_SPACE[1:]}+"
    places = f"SELECT doc_id, n, m[i] AS word, 6.0 * CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS DOUBLE) AS px FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, n, regexp_extract_all(ls[n + 1], '{token}') AS m, string_split_regex(ls[n + 1], '{token}') AS g FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))))"
    amounts = r"SELECT doc_id, n, px, word AS x FROM w WHERE regexp_full_match(word, '\$?\d[\d,.\s]{2,}') AND NOT regexp_full_match(word, '20\d{2}')"
    return (
        f"WITH w AS ({places}), a AS (SELECT * FROM ({_valued_sql(amounts, 'doc_id, n, px')}) WHERE v >= {layout.LEAST_AMOUNT} AND NOT (v = floor(v) AND v BETWEEN 1900 AND 2100)), "
        r"y AS (SELECT doc_id, n, px, word FROM w WHERE regexp_full_match(word, '20\d{2}')), f AS (SELECT doc_id, 12.0 * min(n) AS top FROM y GROUP BY 1), "
        f"e AS (SELECT w.doc_id, min(12.0 * n) - 10 AS stop FROM w JOIN f ON f.doc_id = w.doc_id WHERE contains(upper(word), 'TOTAL') AND 12.0 * n > f.top + {layout.BELOW_YEARS} GROUP BY 1), "
        "c AS (SELECT a.doc_id, a.n, a.px, a.v, y.word, y.px AS yx FROM a JOIN y ON y.doc_id = a.doc_id AND y.n = a.n LEFT JOIN e ON e.doc_id = a.doc_id WHERE e.stop IS NULL OR 12.0 * a.n < e.stop QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.n, a.px ORDER BY abs(y.px - a.px), y.px) = 1), "
        f"g AS (SELECT * FROM c WHERE abs(yx - px) <= {layout.REACH} QUALIFY row_number() OVER (PARTITION BY doc_id, n, word, yx ORDER BY px) = 1) "
        "SELECT doc_id AS page_id, CAST(word AS INTEGER) AS year, v AS amount, px AS x, CAST(12.0 * n AS DOUBLE) AS top FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, word, round_even(v, 0) ORDER BY px DESC, n) = 1"
    )


def _totals_sql() -> str:
    limits = ", ".join(map(str, text.FORM_LIMITS))
    kinds = [("se", rows._THOUSANDS, 0), *[("sl", p, 1) for p in rows.SECTION_TOTALS], ("ae", rows._COMMAS + r"\b", 0), *[("al", p, 1) for p in rows.ATTACHMENT_TOTALS]]
    raws = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}', {group})) AS x FROM d" for kind, p, group in kinds)
    clues = " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in rows.SUMMARY_CLUES)
    return (
        f"WITH d AS (SELECT doc_id, {_upper_sql()} AS t FROM documents), v AS ({_valued_sql(raws, 'doc_id, kind')}), "
        f"s AS (SELECT doc_id, max(v) FILTER (kind = 'sl' AND v NOT IN ({limits})) AS sl, max(v) FILTER (kind = 'se' AND v NOT IN ({limits})) AS se, max(v) FILTER (kind = 'al') AS al, max(v) FILTER (kind = 'ae' AND v NOT IN ({limits})) AS ae, count(DISTINCT v) FILTER (kind = 'al' OR kind = 'ae' AND v NOT IN ({limits})) AS amounts FROM v GROUP BY 1), "
        f"j AS (SELECT d.doc_id, contains(t, 'SCHEDULE E') AS section, {clues} >= 2 OR al IS NOT NULL AS summary, sl, se, al, ae, coalesce(amounts, 0) AS amounts FROM d LEFT JOIN s ON s.doc_id = d.doc_id) "
        "SELECT doc_id, section, CASE WHEN section THEN coalesce(sl, se) END AS section_total, summary, CAST(amounts AS BIGINT) AS amounts, coalesce(al, CASE WHEN summary THEN ae END) AS summary_total FROM j"
    )


def _need_sql() -> str:
    word = r"[\p{L}\p{N}_]"
    odd = "len(x) >= 4 AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]') OR contains(x, '\\') OR contains(x, '€')"
    terms = " + ".join(f"CAST(contains(m, '{t}') AS INT)" for t in pages.TERMS)
    gone = lambda cls: f"length(w) - length(regexp_replace(w, '{cls}', '', 'g'))"
    read = f"SELECT doc_id, CAST(length(regexp_replace(w, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS BIGINT) AS characters, {gone(chr(92) + 'p{L}')} AS letters, CAST({gone(chr(92) + 'p{Nd}')} AS BIGINT) AS digits, len(list_filter(regexp_extract_all(w, '{word}(?:[^{_SPACE[1:]}*{word})?'), lambda x: {odd})) AS odd, CAST({terms} AS BIGINT) AS terms FROM (SELECT doc_id, coalesce(text, '') AS w, coalesce({_mended_sql(f'lower({_COLLAPSED})', text.LOWER_REPAIRS)}, '') AS m FROM documents)"
    reason = f"CASE WHEN characters < {pages.CHARS_A_PAGE} THEN 'little text' WHEN letters < {pages.LETTERS_A_PAGE} AND digits < {pages.DIGITS_A_PAGE} THEN 'few letters and digits' WHEN odd >= {pages.ODD_TOKENS} THEN 'odd tokens' WHEN terms < {pages.LEAST_TERMS} THEN 'few terms' END"
    return f"SELECT doc_id, characters, digits, terms, {reason} AS reason FROM ({read})"


def _flags_sql() -> str:
    mended = _upper_sql()
    present = ", ".join(f"{' OR '.join(f"contains(t, '{w}')" for w in words)} AS {name}" for name, words in text.PRESENT_FLAGS.items())
    cut = lambda a, b: f"CASE WHEN contains(f, '{a}') THEN substr(f, strpos(f, '{a}'), CASE WHEN contains(substr(f, strpos(f, '{a}')), '{b}') THEN strpos(substr(f, strpos(f, '{a}')), '{b}') - 1 ELSE length(f) END) ELSE '' END"
    checked = ", ".join(f"regexp_matches({cut(a, b)}, '{text.CHECKED}{p}') AS {name}" for name, (a, b, p) in text.CHECKED_FLAGS.items())
    clues = " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in text.SIGNATURE_WORDS)
    return f"SELECT doc_id, {present}, {checked}, {clues} >= {text.LEAST_SIGNATURE_WORDS} AS signature_block_detected FROM (SELECT doc_id, t, regexp_replace(t, '\\s+', ' ', 'g') AS f FROM (SELECT doc_id, {mended} AS t FROM documents))"


def _first_of_sql(column: str, patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_replace(regexp_extract({column}, '(?i){p.replace(chr(39), chr(39) * 2)}', 1), '{_SPACE}+', ' ', 'g')), '')" for p in patterns) + ")"


def oracle_sql() -> dict[str, str]:
    factors = ", ".join(map(str, FACTORS))
    anchors = ", ".join(f"({i}, '{a}', {x}, {y})" for i, (a, x, y) in enumerate(ANCHORS))
    keywords = " ".join(f"WHEN contains(lower(p_name), '{k}') THEN {v}" for k, v in KEYWORDS)
    sheet = ", ".join(f"({i}, {f})" for i, f in enumerate([*WORKSHEET, WORKSHEET[-1]]))
    page = _page_sql()
    slug = "regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '-(central-|county-)?appraisal-district$', '-cad')"
    key = "trim(regexp_replace(lower(status), '[^a-z0-9]+', ' ', 'g'))"
    count = lambda cls: f"CAST(length(text) - length(regexp_replace(text, '{cls}', '', 'g')) AS BIGINT)"
    return {
        "money_parse": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS amount FROM lineitem",
        "amounts_in_text": r"SELECT doc_id, count(*) AS amounts, round(max(CAST(regexp_replace(x, '[$,\s]', '', 'g') AS DOUBLE)), 2) AS largest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\$\s?\d[\d,]*(?:\.\d\d)?')) AS x FROM documents) GROUP BY 1",
        "years_in_text": r"SELECT CAST(y AS BIGINT) AS year, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:19[5-9]\d|20[0-4]\d)\b')) AS y FROM documents) GROUP BY 1",
        "evidence_snippets": _places_sql("TOTAL", f"doc_id, found_at AS place, trim(regexp_replace(substr(text, greatest(found_at - 90, 0) + 1, found_at + 95 - greatest(found_at - 90, 0)), '{_SPACE}+', ' ', 'g')) AS snippet"),
        "year_places": _places_sql(text.YEAR_IN_TEXT, "doc_id, found_at AS place, CAST(hit AS BIGINT) AS year"),
        "candidate_lines": f"SELECT doc_id, count(*) FILTER (length(x) >= 4 AND NOT regexp_matches(upper(x), '^SCHEDULE |TOTAL|{'|'.join(text.HEAD_WORDS)}')) AS candidate_lines FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')), '{_SPACE}+', ' ', 'g')) AS x FROM documents) GROUP BY 1",
        "document_metadata": f"SELECT doc_id, {_first_of_sql('t', pages.TAX_YEAR)} AS tax_year, {_first_of_sql('t', pages.OWNER)} AS owner_name, regexp_replace(upper({_first_of_sql('t', pages.ACCOUNT)}), '[^A-Z0-9]', '', 'g') AS account_number, {_first_of_sql('t', pages.SIGNED)} AS signed_date FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "document_quality": f"WITH x AS (SELECT doc_id, lower(coalesce({_COLLAPSED}, '')) AS t FROM documents), y AS (SELECT doc_id, t, length(t) AS n, length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) AS letters, list_filter({list(pages.SCHEDULES)}, lambda s: NOT contains(t, 'schedule ' || lower(s))) AS ms, list_filter({list(pages.COLUMNS)}, lambda s: NOT contains(t, s)) AS mc FROM x), z AS (SELECT *, round(CAST(0.35 * least(1.0, n / 700.0) + 0.35 * ((5 - len(ms)) / 5) + 0.2 * ((6 - len(mc)) / 6) + 0.1 * CASE WHEN n > 0 THEN letters / n ELSE 0 END AS DOUBLE), 3) AS score FROM y) SELECT doc_id, score, n > 0 AND score >= 0.55 AND 5 - len(ms) >= 2 AS usable, array_to_string(ms, ',') AS missing_schedules, array_to_string(mc, ',') AS missing_columns, (6 - len(mc)) / 6 < 0.34 AS columns_unreadable FROM z",
        "reading_need": _need_sql(),
        "year_amount_pairs": _pairs_sql(),
        "section_rows": _rows_sql(),
        "section_totals": _totals_sql(),
        "page_flags": "SELECT district_id, coalesce(sum(length(text)), 0) < 50 AS low_text, bool_or(text IS NULL) AS unavailable, coalesce(string_agg(DISTINCT CASE WHEN text = '' THEN 'empty ' || doc_kind END, '|' ORDER BY CASE WHEN text = '' THEN 'empty ' || doc_kind END), '') AS errors FROM documents WHERE district_id IS NOT NULL GROUP BY 1",
        "provider_summary": "SELECT district_id, source, count(*) AS pages, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters, arg_min(doc_kind, doc_id) FILTER (doc_kind IS NOT NULL) AS text_source FROM documents WHERE district_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2 HAVING bool_or(length(trim(text)) > 0)",
        "merged_readings": "WITH x AS (SELECT * FROM documents WHERE district_id IS NOT NULL AND tax_year IS NOT NULL), l AS (SELECT district_id, tax_year, text FROM x WHERE source = 'scan_batch' AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY district_id, tax_year ORDER BY length(text) DESC, text DESC) = 1), r AS (SELECT district_id, tax_year, text FROM x WHERE source = 'mail_room' AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY district_id, tax_year ORDER BY length(text) DESC, text DESC) = 1), ln AS (SELECT DISTINCT district_id, tax_year FROM x WHERE source = 'scan_batch'), rn AS (SELECT DISTINCT district_id, tax_year FROM x WHERE source = 'mail_room'), b AS (SELECT district_id, tax_year, l.text AS lt, r.text AS rt, length(trim(coalesce(l.text, ''))) AS a, length(trim(coalesce(r.text, ''))) AS b, ln.tax_year IS NOT NULL AS has_l, rn.tax_year IS NOT NULL AS has_r FROM (ln FULL JOIN rn USING (district_id, tax_year)) LEFT JOIN l USING (district_id, tax_year) LEFT JOIN r USING (district_id, tax_year)) SELECT district_id, CAST(tax_year AS BIGINT) AS tax_year, length(t) AS characters, md5(t) AS text_md5, preferred, sources FROM (SELECT district_id, tax_year, CASE WHEN b > a THEN coalesce(nullif(rt, ''), lt, '') ELSE coalesce(nullif(lt, ''), rt, '') END AS t, CASE WHEN b > a THEN 'mail_room' WHEN lt IS NOT NULL OR rt IS NULL THEN 'scan_batch' ELSE 'scan_batch' END AS preferred, concat_ws('|', CASE WHEN a > 0 THEN 'scan_batch' END, CASE WHEN b > 0 THEN 'mail_room' END) AS sources FROM b)",
        "repaired_text": f"SELECT doc_id, md5({_mended_sql(f'lower({_COLLAPSED})', text.LOWER_REPAIRS)}) AS lower_md5, md5(regexp_replace({_mended_sql('upper(text)', text.UPPER_REPAIRS)}, '[ \\t\\x0b\\x0c\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS upper_md5 FROM documents WHERE text IS NOT NULL",
        "schedule_values": r"WITH h AS (SELECT district_id, doc_id, regexp_extract_all(text, '(?i)\bSCHEDULE\s+([A-F])\b', 1) AS h, string_split_regex(text, '(?i)\bSCHEDULE\s+[A-F]\b') AS g FROM documents WHERE text IS NOT NULL AND district_id IS NOT NULL), s AS (SELECT district_id, doc_id, upper(h[i]) AS letter, g[i + 1] AS body FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM h) QUALIFY row_number() OVER (PARTITION BY district_id, doc_id, upper(h[i]) ORDER BY i DESC) = 1), v AS (SELECT district_id, doc_id, letter, unnest(CASE WHEN len(regexp_extract_all(body, '\$\s?\d[\d,]*(?:\.\d\d)?')) = 0 THEN ['x'] ELSE regexp_extract_all(body, '\$\s?\d[\d,]*(?:\.\d\d)?') END) AS raw FROM s), w AS (SELECT *, TRY_CAST(regexp_replace(raw, '[$,\s]', '', 'g') AS DOUBLE) AS a FROM v) SELECT district_id, letter, count(DISTINCT doc_id) AS pages, count(DISTINCT CASE WHEN a BETWEEN 100 AND 1e9 AND NOT (a = floor(a) AND a BETWEEN 1900 AND 2049) AND a NOT IN (20000, 125000) THEN a END) AS amounts, max(CASE WHEN a BETWEEN 100 AND 1e9 AND NOT (a = floor(a) AND a BETWEEN 1900 AND 2049) AND a NOT IN (20000, 125000) THEN a END) AS largest FROM w GROUP BY 1, 2",
        "value_guardrail": "WITH c AS (SELECT DISTINCT account_number, recommended_value AS v FROM review_queue WHERE account_number IS NOT NULL AND recommended_value IS NOT NULL) SELECT summary_id, c.v AS recommended_value, s.recommended_value IS NOT NULL AND c.v IS NULL AS rejected FROM sample_rendition_summary s LEFT JOIN c ON c.account_number = s.account_number AND c.v = s.recommended_value",
        "trust_of_rows": f"WITH s AS (SELECT {key} AS state FROM review_queue) SELECT CAST(CASE state WHEN 'ready' THEN 30 WHEN 'locked' THEN 60 WHEN 'accepted' THEN 50 ELSE 0 END AS BIGINT) AS trust, coalesce(state NOT IN ('ready', 'locked', 'accepted', 'unknown'), true) AS unmapped, count(*) AS rows FROM s GROUP BY 1, 2",
        "owners_resolved": "WITH m AS (SELECT s_suppkey AS member, CASE WHEN s_acctbal > 0 THEN s_suppkey * 2 END AS person, lower('Customer#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0')) AS mail FROM supplier) SELECT c_custkey AS person, coalesce(a.member, b.member) AS member, a.member IS NULL AND b.member IS NOT NULL AND b.person IS NULL AS backfill FROM customer LEFT JOIN m a ON a.person = c_custkey LEFT JOIN m b ON b.mail = lower(c_name)",
        "stamped_upsert": "SELECT id, CAST(length(name) AS BIGINT) AS letters, coalesce(name = upper(name), false) OR year(updated_at) = 2030 AS changed FROM districts",
        "kinds_by_like": "SELECT CASE WHEN lower(trim(file_name)) LIKE '%.pdf' THEN 'pdf' WHEN lower(trim(file_name)) LIKE '%.tif%' THEN 'scan' WHEN lower(trim(file_name)) LIKE 'rendition%' THEN 'rendition' ELSE 'other' END AS kind, count(*) AS rows FROM review_queue GROUP BY 1",
        "union_of_schedules": "SELECT CAST(0 AS BIGINT) AS source, count(o_totalprice) AS prices, CAST(0 AS BIGINT) AS quantities, count(*) AS rows FROM orders UNION ALL SELECT 1, 0, count(l_quantity), count(*) FROM lineitem",
        "confidence_labels": "SELECT district_id, round(coalesce(avg(agent_confidence), 0.0), 3) AS confidence, CASE WHEN round(coalesce(avg(agent_confidence), 0.0), 3) >= 0.8 THEN 'high' WHEN round(coalesce(avg(agent_confidence), 0.0), 3) >= 0.55 THEN 'medium' ELSE 'low' END AS label FROM sample_rendition_summary GROUP BY 1",
        "page_one_flags": _flags_sql(),
        "file_stems": r"SELECT queue_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(coalesce(file_name, ''), '/+$', ''), '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'rendition') AS stem, upper(regexp_replace(coalesce(account_number, ''), '[^A-Za-z0-9]', '', 'g')) AS account FROM review_queue",
        "schedule_sections": r"SELECT doc_id, CAST(i AS BIGINT) AS pos, upper(h[i]) AS letter, CAST(len(string_split(b, chr(10))) AS BIGINT) AS lines, md5(b) AS body_md5 FROM (SELECT doc_id, h, i, regexp_replace(g[i + 1], '^\s*|\s+$', '', 'g') AS b FROM (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?i)\bSCHEDULE\s+([A-F])\b', 1) AS h, string_split_regex(text, '(?i)\bSCHEDULE\s+[A-F]\b') AS g FROM documents WHERE text IS NOT NULL)))",
        "last_sections": r"SELECT doc_id, upper(h[i]) AS letter, CAST(max(i) AS BIGINT) AS pos FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?i)\bSCHEDULE\s+([A-F])\b', 1) AS h FROM documents WHERE text IS NOT NULL)) GROUP BY 1, 2",
        "district_slugs": f"SELECT id, {slug} AS made_slug, {slug} = slug AS as_stored FROM districts",
        "tax_years": r"SELECT CAST(coalesce(nullif(regexp_extract(tax_year, '(20\d\d)', 1), ''), '20' || nullif(regexp_extract(tax_year, '''(\d\d)', 1), '')) AS BIGINT) AS year, count(*) AS rows FROM review_queue GROUP BY 1",
        "status_counts": f"SELECT {key} AS status_key, count(*) AS rows, round(sum(recommended_value), 2) AS value FROM review_queue GROUP BY 1",
        "email_domains": r"WITH m AS (SELECT lower(split_part(x, '@', 2)) AS domain_read, count(*) AS mails FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+')) AS x FROM documents) GROUP BY 1), d AS (SELECT lower(domain) AS domain_read, min(slug) AS slug FROM districts WHERE domain IS NOT NULL GROUP BY 1) SELECT domain_read, coalesce(mails, 0) AS mails, slug FROM m FULL JOIN d USING (domain_read)",
        "queue_latest": "SELECT district_id, file_name, queue_id, recommended_value FROM review_queue WHERE file_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY district_id, file_name ORDER BY queue_id DESC) = 1",
        "newest_event": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "top_orders": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
        "conflict_flag": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS distinct_values, count(DISTINCT o_orderpriority) > 1 AS conflict FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY 1",
        "dedupe_items": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1",
        "schedule_totals": "SELECT l_suppkey, " + ", ".join(f"round(sum(CASE WHEN l_returnflag || l_linestatus = '{v}' THEN l_quantity ELSE 0 END), 2) AS {v.lower()}" for v in ("AF", "NO", "RF", "NF")) + " FROM lineitem GROUP BY 1",
        "floor_factors": f"WITH f(life, year, factor) AS (VALUES {factors}), o AS (SELECT o_orderkey, CAST([5, 8, 9][CAST(o_orderkey % 3 + 1 AS INT)] AS BIGINT) AS life, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders), m AS (SELECT life, min(year) AS y, arg_min(factor, year) AS old FROM f GROUP BY 1) SELECT o_orderkey, o.life, o.year, CAST(coalesce(f.factor, CASE WHEN o.year < m.y THEN m.old END) AS DOUBLE) AS factor FROM o LEFT JOIN f ON f.life = o.life AND f.year = o.year LEFT JOIN m ON m.life = o.life",
        "keyword_class": f"SELECT p_partkey, CAST(CASE {keywords} END AS BIGINT) AS life FROM part",
        "priority_match": "SELECT o_orderkey, coalesce(c_mktsegment, s_name) AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey LEFT JOIN supplier ON o_custkey = s_suppkey",
        "label_band": "WITH i AS (SELECT l_orderkey, l_returnflag, l_linenumber || '-' || l_partkey AS id, CAST(l_linenumber * 40 + l_partkey % 40 AS BIGINT) AS place FROM lineitem), l AS (SELECT DISTINCT l_orderkey, id, place FROM i WHERE l_returnflag = 'R'), v AS (SELECT * FROM i WHERE l_returnflag <> 'R') SELECT l.l_orderkey, l.id AS label_id, v.id AS value_id, abs(v.place - l.place) AS gap FROM l JOIN v ON v.l_orderkey = l.l_orderkey AND v.place - l.place BETWEEN -40 AND 120 QUALIFY row_number() OVER (PARTITION BY l.l_orderkey, l.id ORDER BY abs(v.place - l.place), v.place, v.id) = 1",
        "nearest_region": f"WITH a(i, n, ax, ay) AS (VALUES {anchors}) SELECT p_partkey, n AS region, CAST(round(abs(p_partkey % 97 - ay) * 2.5 + abs(p_size - ax), 4) AS DOUBLE) AS cost FROM part, a QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_partkey % 97 - ay) * 2.5 + abs(p_size - ax), i) = 1",
        "full_outer_merge": "WITH a AS (SELECT c_custkey * 2 AS k, c_name AS s FROM customer), b AS (SELECT s_suppkey * 3 AS k, s_name || CASE WHEN s_acctbal > 0 THEN ' in credit' ELSE '' END AS s FROM supplier) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.s IS NOT NULL AND (b.s IS NULL OR length(a.s) >= length(b.s)) THEN a.s ELSE b.s END AS shown, CASE WHEN a.s IS NOT NULL AND (b.s IS NULL OR length(a.s) >= length(b.s)) THEN 'left' ELSE 'right' END AS origin FROM a FULL JOIN b ON a.k = b.k",
        "provider_reconcile": "WITH r AS (SELECT o_orderkey, unnest([o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 0.5 END, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 7 END]) AS v FROM orders) SELECT o_orderkey, count(v) AS readings, round(max(v) - min(v), 2) AS spread, CASE WHEN count(v) < 2 THEN 'single' WHEN max(v) - min(v) <= 1.0 THEN 'agree' ELSE 'disagree' END AS verdict, CASE WHEN count(v) >= 2 AND max(v) - min(v) <= 1.0 THEN round(avg(v), 2) END AS agreed FROM r GROUP BY 1",
        "provider_priority": "SELECT district_id, CAST(tax_year AS BIGINT) AS tax_year, source, md5(text) AS text_md5 FROM (SELECT *, CASE source WHEN 'scan_batch' THEN 0 WHEN 'mail_room' THEN 1 WHEN 'district_site' THEN 2 ELSE 3 END AS r FROM documents WHERE district_id IS NOT NULL AND tax_year IS NOT NULL AND length(trim(text)) > 0) QUALIFY row_number() OVER (PARTITION BY district_id, tax_year ORDER BY r, source, text) = 1",
        "union_of_candidates": "WITH x AS (SELECT CAST(s_nationkey AS BIGINT) AS nation, s_name AS who, 0 AS p FROM supplier UNION ALL SELECT c_nationkey, c_name, 1 FROM customer) SELECT nation, who FROM x QUALIFY row_number() OVER (PARTITION BY nation ORDER BY p, who) = 1",
        "flag_union": "WITH x AS (SELECT l_suppkey, 'deep_discount' AS f FROM lineitem WHERE l_discount > 0.08 UNION SELECT l_suppkey, 'tiny' FROM lineitem WHERE l_quantity < 3 UNION SELECT l_suppkey, 'untaxed' FROM lineitem WHERE l_tax = 0) SELECT l_suppkey, string_agg(f, '|' ORDER BY f) AS flags FROM x GROUP BY 1",
        "carry_forward": "SELECT event_id, CASE WHEN event_type = 'error' AND last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'purchase' THEN 'purchase' ELSE event_type END AS carried FROM events",
        "schedule_headings": r"SELECT doc_id, CAST(unnest(range(1, len(a) + 1)) AS BIGINT) AS pos, unnest(a) AS heading FROM (SELECT doc_id, regexp_extract_all(text, '\bSCHEDULE\s+([A-F])\b', 1) AS a FROM documents)",
        "gap_segments": "WITH x AS (SELECT user_id, ts, event_id, epoch_us(ts) / 1e6 AS s FROM events), y AS (SELECT user_id, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800 THEN 0 ELSE 1 END AS n FROM x) SELECT user_id, CAST(sum(n) AS BIGINT) AS segments, count(*) AS events FROM y GROUP BY 1",
        "worksheet_rows": f"WITH f(i, factor) AS (VALUES {sheet}), y AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS year FROM orders) SELECT year, CAST(i AS BIGINT) AS \"offset\", CAST(factor AS DOUBLE) AS factor, CAST(year - 1 - i AS BIGINT) AS acquired, i = {len(WORKSHEET)} AS prior FROM y, f",
        "page_types": f"SELECT doc_kind, page_type, count(*) AS pages, round(sum(score), 2) AS score FROM ({page}) GROUP BY 1, 2",
        "page_type_of": f"SELECT doc_id, page_type, score FROM ({page})",
        "text_quality": f"SELECT doc_id, letters, digits, blanks, round(letters / nullif(n, 0), 6) AS letter_share, round(digits / nullif(n, 0), 6) AS digit_share FROM (SELECT doc_id, length(text) AS n, {count('[A-Za-z]')} AS letters, {count('[0-9]')} AS digits, " + count(r"[ \t\r\n]") + " AS blanks FROM documents WHERE text IS NOT NULL)",
        "best_candidate": "WITH x AS (SELECT o_custkey, o_orderkey, CAST(round(greatest(0, (o_orderkey % 7) / 10.0 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.2 ELSE 0 END - CASE WHEN o_orderstatus = 'F' THEN 0.1 ELSE 0 END), 4) AS DOUBLE) AS score FROM orders) SELECT o_custkey, o_orderkey, score FROM x QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1",
        "upsert_customers": "WITH u AS (SELECT s_suppkey * 7 AS k, s_name AS who, s_acctbal AS balance FROM supplier) SELECT * FROM u UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM u)",
        "fill_districts": "SELECT queue_id, district_id AS id, coalesce(q.district_slug, d.slug) AS slug FROM review_queue q LEFT JOIN districts d ON d.id = q.district_id",
        "append_new_customers": "SELECT c_custkey AS k, c_name AS who FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey * 5, s_name FROM supplier WHERE s_suppkey * 5 NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
        "without_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)",
        "with_orders": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
        "rule_violations": "SELECT rule, count(*) AS rows FROM (SELECT 'value_missing' AS rule FROM review_queue WHERE recommended_value IS NULL UNION ALL SELECT 'account_missing' FROM review_queue WHERE coalesce(trim(account_number), '') = '' UNION ALL SELECT 'owner_missing' FROM review_queue WHERE coalesce(trim(owner_name), '') = '') GROUP BY 1",
        "duplicate_files": "SELECT file_name, count(*) AS rows FROM review_queue WHERE file_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "tenant_rank": "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END NULLS LAST, c_custkey) AS r FROM customer) WHERE r <= 5",
        "event_properties": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY 1",
        "district_profile": "SELECT slug, count(*) AS rows, round(sum(recommended_value), 2) AS value FROM review_queue JOIN districts ON id = district_id GROUP BY slug",
        "order_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_discount > 0.02 GROUP BY 1",
        "windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    }
