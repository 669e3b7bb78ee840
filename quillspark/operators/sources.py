"""A registry of sources and what hangs on it: checks, ordered lookups, joins with captures, passages and served files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical, straight_quotes
from ..functions.urls import government_url, safe_url
from .common import small_side
from .containment import containing
from .timeline import shown_day

#: What a row of the registry must have, and the words that it may use. Fixed values.
REQUIRED = ("source_id", "title", "url", "origin", "copyright_status", "legal_tier", "content_type", "license_notes", "access", "scrape_method", "update_check", "corpus_version_first_included")
TIERS, CONTENT_TYPES, CADENCES = ("confident_pd", "verified_gray_zone", "excluded"), ("html", "pdf"), ("weekly", "monthly")
DATES = ("source_updated_date", "reviewed_date", "terms_reviewed_date")
PUBLISHERS = {"VA": "VA", "DOL": "DOL", "DoW": "DoD", "DoD": "DoD", "FRTIB": "TSP"}


def _real_day(text: Column) -> Column:
    day = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd") == text, F.lit(False))


def registry_faults(rows: DataFrame) -> DataFrame:
    """(source_id, code, field): everything that is wrong with each row of a registry, never the first thing alone. A null is a
    missing value; of rows that share an id all but one are duplicates."""
    c, other = F.col, lambda name, words: F.col(name).isNotNull() & ~F.col(name).isin(*words)
    served, pdf, html = F.coalesce("served", F.lit(False)), F.coalesce(c("content_type") == "pdf", F.lit(False)), F.coalesce(c("content_type") == "html", F.lit(False))
    included = ~c("legal_tier").eqNullSafe(F.lit("excluded"))
    rules = [("missing_field", f, c(f).isNull()) for f in REQUIRED]
    rules += [("bad_id", "source_id", ~c("source_id").rlike("^[a-z0-9_]+$")), ("bad_url", "url", c("url").isNotNull() & ~safe_url(c("url")))]
    rules += [("bad_tier", "legal_tier", other("legal_tier", TIERS)), ("bad_content_type", "content_type", other("content_type", CONTENT_TYPES)), ("bad_cadence", "update_check", other("update_check", CADENCES))]
    rules += [("bad_date", f, c(f).isNotNull() & ~_real_day(c(f))) for f in DATES]
    rules += [("missing_review", "reviewed_date", included & (c("reviewed_by").isNull() | c("reviewed_date").isNull())), ("missing_review", "terms_reviewed_date", included & c("terms_reviewed_date").isNull())]
    rules += [("html_served", "served", served & ~pdf), ("served_not_cleared", "redistribution_cleared", served & ~F.coalesce("redistribution_cleared", F.lit(False)))]
    rules += [("pdf_no_document_url", "document_url", pdf & c("document_url").isNull()), ("bad_url", "document_url", pdf & c("document_url").isNotNull() & ~safe_url(c("document_url"))), ("html_document_url", "document_url", html & c("document_url").isNotNull())]
    marks = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(f).alias("field"))) for code, f, broken in rules]
    each = rows.select("source_id", F.explode(F.array_compact(F.array(*marks))).alias("e")).select("source_id", "e.*")
    twice = rows.where("source_id IS NOT NULL").groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1")
    repeats = twice.select("source_id", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("source_id", F.lit("dup_id").alias("code"), F.lit("source_id").alias("field"))
    return each.unionByName(repeats)


def passage_faults(passages: DataFrame, registry: DataFrame, texts: DataFrame) -> DataFrame:
    """(source, code) of what is wrong with passages (id, source, anchor: the canonical window, or null) against a registry
    (source, legal_tier) and canonical texts (source, text): unknown_source, excluded_source, bad_id, dup_id, anchor_unresolved,
    anchor_ambiguous. Texts are joined to windows by source, and a second place is sought behind the first."""
    known = passages.join(small_side(registry.select("source", "legal_tier")), "source", "left")
    faults = F.array_compact(
        F.array(
            F.when(F.col("legal_tier").isNull(), "unknown_source").when(F.col("legal_tier") == "excluded", "excluded_source"),
            F.when(~F.col("id").rlike("^[a-z0-9_]+:[0-9a-f]{12}(-[0-9]+)?$"), "bad_id"),
        )
    )
    own = known.select("source", F.explode(faults).alias("code"))
    twice = passages.groupBy("id").agg(F.min("source").alias("source"), F.count("*").alias("n")).where("n > 1").select("source", F.explode(F.sequence(F.lit(2).cast("long"), "n")).alias("k")).select("source", F.lit("dup_id").alias("code"))
    anchored = passages.where("anchor IS NOT NULL").join(texts.select("source", "text"), "source", "left")
    first = F.when(F.col("anchor") != "", F.instr("text", F.col("anchor"))).otherwise(0)
    placed = anchored.withColumn("first", F.coalesce(first, F.lit(0))).withColumn("second", F.expr("CASE WHEN first > 0 THEN locate(anchor, text, first + 1) ELSE 0 END"))
    lost = placed.select("source", F.when(F.col("first") == 0, "anchor_unresolved").when(F.col("second") > 0, "anchor_ambiguous").alias("code")).where("code IS NOT NULL")
    return own.unionByName(twice).unionByName(lost)


def listed(keys: DataFrame, items: DataFrame, ids: str = "ids", id_col: str = "id") -> DataFrame:
    """Rows of ``keys`` (with an array of ids) beside the items that they list, with their place ``pos`` in the list; ids that
    aren't items are left out."""
    each = keys.select("*", F.posexplode(ids).alias("pos", id_col)).drop(ids)
    return each.join(items, id_col)


def after_link(keys: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """(key, label, url): the link (key, id, label) of each key, its url from the items (id, url); null where either is missing."""
    known = links.join(items.select("id", "url"), "id").select("key", "label", "url")
    return keys.select("key").join(known, "key", "left")


def library(paths: DataFrame, info: DataFrame, sizes: DataFrame, states: DataFrame) -> DataFrame:
    """Documents (source, path) that have all of info, size and state."""
    return paths.join(info, "source").join(sizes, "source").join(states, "source")


def by_category(items: DataFrame, category: str, order: str) -> DataFrame:
    """(category, nth, first, ...): items numbered within their category in order, with where the category comes first. A row an
    item, so a category may have any size."""
    firsts = items.groupBy(category).agg(F.min(order).alias("first"))
    nth = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return items.join(small_side(firsts), category).withColumn("nth", nth)


def folded_for_match(text: Column) -> Column:
    """Canonical form with straight quotes."""
    return straight_quotes(canonical(text))


def expected_ids(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(query, id) of the passages (id, source, text) of a question's source in whose folded text its folded snippet stands, once each."""
    asked = questions.select(F.col("query").alias("key"), "source", folded_for_match(F.col("snippet")).alias("snippet"))
    held = passages.select("id", "source", folded_for_match(F.col("text")).alias("text"))
    return containing(held, asked).withColumnRenamed("key", "query")


def image_mismatches(kept: DataFrame, painted: DataFrame) -> DataFrame:
    """(doc, page, expected, actual) of the pages for which two counts (doc, page, n) differ; a missing one is 0."""
    a, b = kept.withColumnRenamed("n", "expected"), painted.withColumnRenamed("n", "actual")
    return a.join(b, ["doc", "page"], "full").na.fill(0, ["expected", "actual"]).where("expected <> actual")


def audit_copy(content: Column, kind: Column, folder: str = "captures") -> Column:
    """(hash, path, size) of a capture's bytes."""
    raw = content.cast("binary")
    digest = F.sha2(raw, 256)
    return F.struct(digest.alias("hash"), F.concat(F.lit(f"{folder}/"), digest, F.lit("."), kind).alias("path"), F.octet_length(raw).cast("long").alias("size"))


def staged_name(notes: Column) -> Column:
    """The file that notes name, or null."""
    return F.nullif(F.regexp_extract(notes, r"(?i)File:\s*(\S+\.pdf)", 1), F.lit(""))


def manifest(captured: DataFrame) -> DataFrame:
    """Captured rows as a manifest has them: the served path only of what is served."""
    served = F.coalesce("served", F.lit(False))
    return captured.withColumns({"served": served, "served_path": F.when(served & (F.col("served_path") != ""), F.col("served_path"))})


def publisher(origin: Column) -> Column:
    """The publisher that an origin's name up to its bracket stands for; raises for others."""
    name, out = F.trim(F.substring_index(origin, " (", 1)), None
    for short, whole in PUBLISHERS.items():
        out = F.when(name == short, whole) if out is None else out.when(name == short, whole)
    return out.otherwise(F.raise_error(F.concat(F.lit("no publisher for "), origin)))


def sources_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Public columns (title, url: null for PDFs, publisher, kind), and one row (library_url, captured_from, captured_to). Raises if PDFs
    name more than one url or a row has no day of capture."""
    pdf = F.col("content_type") == "pdf"
    public = rows.select("title", F.when(~pdf, F.col("url")).alias("url"), publisher(F.col("origin")).alias("publisher"), F.when(pdf, "guide").otherwise("agency").alias("kind"))
    day = F.when(F.col("captured_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.left("captured_at", F.lit(10)).cast("date")).otherwise(F.raise_error(F.lit("a source has no day of capture")))
    one = rows.agg(F.min(F.when(pdf, F.col("url"))).alias("low"), F.max(F.when(pdf, F.col("url"))).alias("high"), F.min(day).alias("first"), F.max(day).alias("last"))
    url = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNull(), "").otherwise(F.raise_error(F.lit("guides name more than one library")))
    return public, one.select(url.alias("library_url"), F.coalesce(shown_day(F.col("first")), F.lit("")).alias("captured_from"), F.coalesce(shown_day(F.col("last")), F.lit("")).alias("captured_to"))


def document_urls(rows: DataFrame) -> DataFrame:
    """(source_id, document_url) of the PDFs; raises where one is missing."""
    url = F.when(F.coalesce(F.col("document_url") != "", F.lit(False)), F.col("document_url")).otherwise(F.raise_error(F.concat(F.lit("no document url for "), "source_id")))
    return rows.where("content_type = 'pdf'").select("source_id", url.alias("document_url"))


def cited_urls(cited: DataFrame, urls: DataFrame) -> DataFrame:
    """Adds url to (source_id, page): the document's, with its page if that is one; null for unknown documents."""
    page = F.when(F.col("page") >= 1, F.concat(F.lit("#page="), F.col("page").cast("string"))).otherwise("")
    return cited.join(small_side(urls), "source_id", "left").withColumn("url", F.concat("document_url", page)).drop("document_url")


def measured_population(passages: DataFrame, served: DataFrame) -> DataFrame:
    """Passages of served sources that cite a page, with anchored: whether they name what to look for."""
    return passages.where("page IS NOT NULL").join(small_side(served.select("source").distinct()), "source", "left_semi").withColumn("anchored", F.coalesce(F.col("anchor") != "", F.lit(False)))


def narrowed(results: DataFrame, raw: str = "raw") -> DataFrame:
    """(score, id, text, source, title, url, page, section, excerpt, tags) of the well-formed rows of a JSON column: a number as
    score, texts where texts must be, an https url of a government's; others go, tags are empty."""
    texts = {"id": "id", "text": "text", "sourceId": "source", "sourceTitle": "title", "url": "url", "section": "section", "excerpt": "excerpt"}
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda v, path: F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))
    number = lambda v, path, to: F.when(kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, to))
    fields = lambda v: F.struct(number(v, "$.score", "double").alias("score"), *[text(v, f"$.chunk.{k}").alias(n) for k, n in texts.items()], number(v, "$.chunk.page", "long").alias("page"), F.array().cast("array<string>").alias("tags"))
    # a text is parsed once: conditions on what inline gives aren't pushed below it and spelled out there
    out = results.select(F.inline(F.transform(F.array(F.try_parse_json(raw)), fields)))
    must = ("score", "id", "text", "source", "title", "url")
    return out.where(" AND ".join(f"{c} IS NOT NULL" for c in must)).where(F.lower("url").startswith("https://") & government_url(F.col("url")))


def chunks_for_model(results: DataFrame) -> DataFrame:
    """What a summary is written from."""
    return results.select("id", "text", "url", "title", "source", "page")


def cards(results: DataFrame, shown: Column, exact: Column) -> DataFrame:
    """What a result shows: the excerpt, else the text, made fit to show, and what to look for, else the text."""
    return results.select("source", "title", "id", "page", "section", shown.alias("excerpt"), F.coalesce(exact, F.col("text")).alias("anchor"), "url", "score")


def acronyms_printed(texts: DataFrame, text: str = "text") -> DataFrame:
    """(acronym): capitals in brackets that any of the texts prints."""
    found = F.regexp_extract_all(text, F.lit(r"\[([A-Za-z0-9_.:-]+)\]"), F.lit(1))
    return texts.select(F.explode(F.array_distinct(F.filter(found, lambda x: x.rlike("^[A-Z]+$")))).alias("acronym")).distinct()


def robots_rules(files: DataFrame, agent: str, host: str = "host", text: str = "robots") -> DataFrame:
    """(host, prefix, allow, ord) that hold for ``agent``, from robots files (host, text): those of the first group, in the order
    of its first line, whose name the agent's product starts with, else those under *. A line belongs to the user-agent line
    before it; an empty Disallow says nothing."""
    product = agent.lower().split("/")[0].strip()
    lines = files.select(host, F.posexplode(F.split(text, "\r?\n")).alias("ord", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.instr("line", ":") > 0)
    cut = lines.select(host, "ord", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("value"))
    so_far = Window.partitionBy(host).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    group = F.last(F.when(F.col("name") == "user-agent", F.lower("value")), ignorenulls=True).over(so_far)
    cut = cut.withColumn("group", group).where("group IS NOT NULL")
    fits = (F.col("group") != "*") & F.lit(product).startswith(F.col("group"))
    chosen = cut.where(fits).groupBy(host).agg(F.min_by("group", "ord").alias("chosen"))
    rules = cut.where(F.col("name").isin("allow", "disallow") & ((F.col("name") == "allow") | (F.col("value") != "")))
    kept = rules.join(chosen, host, "left").where(F.col("group") == F.coalesce("chosen", F.lit("*")))
    return kept.select(host, F.col("value").alias("prefix"), (F.col("name") == "allow").alias("allow"), "ord")


def stamped(registry: DataFrame, captured: DataFrame, now: str) -> DataFrame:
    """The registry with what a capture (source_id, content_hash, updated) says of each of its rows: hash, path, time (the old one if
    the hash is the same), and the source's own date where it is known. Others stay as they are; stamping twice changes nothing."""
    fresh = captured.select("source_id", F.col("content_hash").alias("_hash"), F.col("updated").alias("_updated"))
    rows = registry.join(fresh, "source_id", "left")
    same = F.col("content_hash").eqNullSafe(F.col("_hash")) & (F.coalesce("captured_at", F.lit("")) != "")
    hit = F.col("_hash").isNotNull()
    path = F.concat(F.lit("captures/"), "_hash", F.lit("."), "content_type")
    new = {"captured_at": F.when(hit & ~same, F.lit(now)).otherwise(F.col("captured_at")), "captured_path": F.when(hit, path).otherwise(F.col("captured_path")), "source_updated_date": F.coalesce(F.when(hit, F.col("_updated")), "source_updated_date")}
    return rows.withColumns(new).withColumn("content_hash", F.when(hit, F.col("_hash")).otherwise(F.col("content_hash"))).drop("_hash", "_updated")


def review_lines(changes: DataFrame) -> DataFrame:
    """(source, status, decision, line) of a refresh: one line of text for each source, decisions still pending."""
    line = F.concat(F.lit("## "), "source", F.lit(" ("), "status", F.lit(")\n"), "reason", F.lit(".\nhash: "), "old_hash", F.lit(" -> "), F.coalesce("new_hash", F.lit("(unfetched)")))
    return changes.select("source", "status", F.lit("pending").alias("decision"), line.alias("line"))


def review_counts(changes: DataFrame, statuses: Sequence[str] = ("changed", "manual-check-required", "unchanged")) -> DataFrame:
    """(status, n, shown) of a refresh: how many sources have each status, and whether the report has lines for them. A clean run, in
    which all are unchanged, has counts alone."""
    tally = changes.agg(F.count("*").alias("all"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n"), (F.lit(s != "unchanged") & (F.col(s) > 0)).alias("shown")) for s in statuses])
    return tally.select(F.inline(rows))


def review_report(changes: DataFrame, title: str, statuses: Sequence[str] = ("changed", "manual-check-required", "unchanged")) -> DataFrame:
    """(ord, source, line) of the whole report: a heading, counts by status, then the lines of what isn't unchanged by source; null
    sources for what is of the run as a whole. Lines stay rows, so a report of any length is no single text."""
    counts = review_counts(changes, statuses)
    told = counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat("status", F.lit(": "), F.col("n").cast("string")))), ", ").alias("counts"), F.max("shown").alias("any"))
    line = lambda ord_, text: F.struct(F.lit(ord_).alias("ord"), text.alias("line"))
    head = told.select(F.inline(F.array(line(0, F.lit(f"# {title}")), line(1, F.col("counts")), line(2, F.when(F.col("any"), F.lit("")).otherwise("nothing to review")))))
    lines = review_lines(changes.where("status <> 'unchanged'")).select(F.lit(3).alias("ord"), "source", "line")
    return head.where("line <> ''").select("ord", F.lit(None).cast(dict(lines.dtypes)["source"]).alias("source"), "line").unionByName(lines)


def approved_ids(pending: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Pending rows (source, decision) with the listed ones approved; raises for an id that isn't there."""
    known = pending.where(F.col("source").isin(*ids)).select("source").distinct().count()
    if known != len(set(ids)):
        raise ValueError("a listed source isn't pending")
    return pending.withColumn("decision", F.when(F.col("source").isin(*ids), "approved").otherwise(F.col("decision")))


def escaped_html(text: Column) -> Column:
    """Text for a page: & < > and both quotes spelled out."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: What a page's operators are that paint images, and those that merge several. Fixed values.
PAINTS, MERGED_PAINTS = ("paintImageXObject", "paintInlineImageXObject", "paintImageMaskXObject"), ("paintImageXObjectRepeat", "paintInlineImageXObjectGroup", "paintImageMaskXObjectGroup", "paintImageMaskXObjectRepeat")


def image_paints(operators: Column, widths: Column, heights: Column) -> Column:
    """How many images of more than one pixel a page's operators (parallel arrays) paint; an operator that merges several is an error."""
    rows = F.arrays_zip(operators.alias("op"), widths.alias("w"), heights.alias("h"))
    merged = F.arrays_overlap(operators, F.array(*map(F.lit, MERGED_PAINTS)))
    painted = F.size(F.filter(rows, lambda x: x["op"].isin(*PAINTS) & (x["w"] * x["h"] > 1))).cast("long")
    return F.when(F.coalesce(merged, F.lit(False)), F.raise_error(F.lit("a merged image operator"))).otherwise(painted)


def with_pictures(manifest: DataFrame) -> DataFrame:
    """(source) of the served documents of which pictures were kept, each once."""
    return manifest.where("kept > 0").select("source").distinct()


def component_text(tag: Column, contact: Column, extension: Column) -> Column:
    """What a telephone element shows, which only its attributes tell; null for other elements or without a number."""
    number, more = F.trim(F.coalesce(contact, F.lit(""))), F.trim(F.coalesce(extension, F.lit("")))
    shown = F.when(more == "", number).otherwise(F.concat(number, F.lit(", ext. "), more))
    return F.when((F.lower(tag) == "va-telephone") & (number != ""), shown)


def paced(requests: DataFrame, group: str, tie: str, at: str, least: int) -> DataFrame:
    """Adds wait: how long each request (by time, then ``tie``) waits so that those of a group start ``least`` apart. A start is the
    greatest, over the requests up to it, of their time and ``least`` for each one since; so no step needs the one before it,
    and groups of any size are summed by slices of a minute first. Requests without a group are a group; one without a time comes
    first in its group, waits null and takes no turn."""
    order = Window.partitionBy(group, "_slice").orderBy(at, tie)
    cut = requests.withColumn("_slice", F.floor(F.col(at) / 60_000)).withColumn("_n", F.when(F.col(at).isNotNull(), F.row_number().over(order)).cast("long"))
    slices = cut.groupBy(group, "_slice").agg(F.count("_n").alias("_many"), F.max(F.col(at) - F.col("_n") * least).alias("_top"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_first", F.coalesce(F.sum("_many").over(before), F.lit(0)))
    slices = slices.select(F.col(group).alias("_group"), F.col("_slice").alias("_its"), "_first", F.max(F.col("_top") - F.col("_first") * least).over(before).alias("_held"))
    out = cut.join(slices, F.col(group).eqNullSafe(F.col("_group")) & F.col("_slice").eqNullSafe(F.col("_its"))).drop("_group", "_its")
    nth = F.col("_first") + F.col("_n")
    own = F.max(F.col(at) - nth * least).over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = F.greatest(own, F.col("_held")) + nth * least
    return out.withColumn("wait", start - F.col(at)).drop("_slice", "_n", "_first", "_held")
