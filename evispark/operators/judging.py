"""Judge answers: which are usable and why not, and what a rollout's behaviour was like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import ledger

SCORED = "struct<items:array<struct<score:double,justification:string>>,conclusion:struct<score:double,justification:string>>"


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The kind of the first rule that is broken; null if none is."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), kind) for kind, broken in rules], F.lit(None).cast("string"))


def scored_items(answers: DataFrame, answer: str, expected: Column) -> DataFrame:
    """answers with `problem`: schema, missing_items, out_of_range or null, for items of whole scores from 0 to 10."""
    parsed = F.from_json(F.col(answer), SCORED)
    items = F.col("_a.items")
    whole = F.forall(items, lambda i: F.coalesce((i["score"] == F.floor(i["score"])) & (F.length(F.trim(i["justification"])) > 0), F.lit(False)))
    raw = F.get_json_object(answer, "$.items[*].score")
    rules = [
        ("schema", items.isNull() | ~whole | F.coalesce(raw.rlike("true|false"), F.lit(False))),
        ("missing_items", F.size(items) != expected),
        ("out_of_range", F.exists(items, lambda i: ~i["score"].between(0, 10))),
    ]
    return answers.withColumn("_a", parsed).withColumn("problem", first_failing(rules)).drop("_a")


def answered(answers: DataFrame, answer: str, questions: dict[str, tuple[str, ...]], depends: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """answers with `problem` for yes-no questions at $.<question>.answer. depends: question -> (other, its answer, the
    only answer that question may then have), whose breach is `inconsistent`."""
    got = {q: F.lower(F.get_json_object(answer, f"$.{q}.answer")) for q in questions}
    rules = [("schema", F.get_json_object(answer, "$").isNull())]
    rules += [("missing_items", got[q].isNull()) for q in questions]
    rules += [("out_of_range", ~got[q].isin(*allowed)) for q, allowed in questions.items()]
    rules += [("inconsistent", (got[other] == value) & (got[q] != only)) for q, (other, value, only) in (depends or {}).items()]
    return answers.withColumn("problem", first_failing(rules))


UPDATES = "struct<items:array<struct<hyps:array<struct<id:string,touched:boolean,direction:string>>,main:string,H5:struct<answer:string>>>>"
CLOSURE = "struct<conclusion:struct<C1a:struct<answer:string>,C1b:struct<answer:string>,C2:struct<answer:string>,claims:array<struct<claim:string,supported:boolean>>,C4:struct<answer:string>>,gap:struct<G1:struct<answer:string>,G2:struct<answer:string>,G3:struct<answer:string>>>"
MOST_CLAIMS = 12


def update_answers(answers: DataFrame, answer: str, expected: Column) -> DataFrame:
    """answers with `problem` for judged updates: each hypothesis touched or not and which way, the main one, and H5."""
    items = F.col("_a.items")
    every = lambda rule: F.forall(items, lambda i: F.forall(i["hyps"], rule))
    there = every(lambda h: h["id"].isNotNull() & h["touched"].isNotNull() & h["direction"].isNotNull())
    ranges = every(lambda h: h["direction"].isin("supports", "weakens", "unrelated")) & F.forall(items, lambda i: i["H5"]["answer"].isin("yes", "no"))
    agree = every(lambda h: h["touched"] == (h["direction"] != "unrelated"))
    main = F.forall(items, lambda i: ~F.exists(i["hyps"], lambda h: h["touched"]) | F.exists(i["hyps"], lambda h: h["touched"] & (h["id"] == i["main"])))
    rules = [
        ("schema", items.isNull() | ~F.coalesce(there & F.forall(items, lambda i: i["H5"]["answer"].isNotNull()), F.lit(False))),
        ("missing_items", F.size(items) != expected),
        ("out_of_range", ~ranges),
        ("inconsistent", ~(agree & F.coalesce(main, F.lit(False)))),
    ]
    return answers.withColumn("_a", F.from_json(F.col(answer), UPDATES)).withColumn("problem", first_failing(rules)).drop("_a")


def closure_answers(answers: DataFrame, answer: str, closed: Column) -> DataFrame:
    """answers with `problem` for judged final answers: a gap is judged if and only if the case stayed open."""
    c, g = F.col("_a.conclusion"), F.col("_a.gap")
    told = [c["C1a"]["answer"], c["C1b"]["answer"], c["C2"]["answer"], c["C4"]["answer"]]
    open_ = [g["G1"]["answer"], g["G2"]["answer"], g["G3"]["answer"]]
    missing = lambda parts: F.exists(F.array(*parts), lambda x: x.isNull())
    claims = F.coalesce(F.forall(c["claims"], lambda x: x["claim"].isNotNull() & x["supported"].isNotNull()), F.lit(False))
    yes_no = [x.isin("yes", "no") for x in (told[0], told[2], told[3])]
    rules = [
        ("schema", c.isNull() | missing(told) | ~claims),
        ("inconsistent", closed & g.isNotNull()),
        ("missing_items", ~closed & (g.isNull() | missing(open_))),
        ("out_of_range", ~(yes_no[0] & yes_no[1] & yes_no[2] & told[1].isin("yes", "partial", "no")) | (F.size(c["claims"]) > MOST_CLAIMS) | (~closed & F.exists(F.array(*open_), lambda x: ~x.isin("yes", "no")))),
    ]
    return answers.withColumn("_a", F.from_json(F.col(answer), CLOSURE)).withColumn("problem", first_failing(rules)).drop("_a")


def audit_replies(replies: DataFrame, reply: str, actions: tuple[str, ...] = ("accept", "revise", "reject")) -> DataFrame:
    """replies with `problem`: another case's, a score that is no whole number from -5 to 5, an unknown action."""
    score = F.get_json_object(reply, "$.score")
    rules = [
        ("schema", F.get_json_object(reply, "$").isNull()),
        ("case", ~F.get_json_object(reply, "$.case_id").eqNullSafe(F.col("case_id"))),
        ("score", ~score.rlike("^-?[0-9]+$") | ~score.cast("int").between(-5, 5)),
        ("action", ~F.get_json_object(reply, "$.action").isin(*actions)),
    ]
    return replies.withColumn("problem", first_failing(rules))


def hypothesis_behaviour(turns: DataFrame, keys: list[str]) -> DataFrame:
    """By rollout: hypotheses, those that came after turn 1, those ruled out at the end, and changes of the leading set."""
    moves = turns.select(*keys, "turn", F.explode(ledger("assistant")).alias("m")).select(*keys, "turn", "m.*")
    out_states = "^(?:weakened|ruled out|excluded|eliminated|rejected|discounted)"
    each = moves.groupBy(*keys, "hypothesis").agg(F.min("turn").alias("first"), F.max_by("after", "turn").alias("last"))
    counts = each.groupBy(*keys).agg(F.count("*").alias("hypotheses"), F.sum((F.col("first") > 1).cast("int")).alias("new_later"), F.sum(F.col("last").rlike(out_states).cast("int")).alias("ruled_out"))
    leading = moves.groupBy(*keys, "turn").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("after").startswith("favo"), F.col("hypothesis")))), ",").alias("lead"))
    leading = leading.withColumn("lead", F.when(F.col("lead") == "", "-").otherwise(F.col("lead")))
    before = F.lag("lead").over(Window.partitionBy(*keys).orderBy("turn"))
    switched = leading.withColumn("_s", ((F.col("lead") != before) & (F.col("lead") != "-") & (before != "-")).cast("int")).groupBy(*keys).agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("switches"))
    return counts.join(switched, keys)


def fetch_behaviour(folded: DataFrame, keys: list[str], key_ids: DataFrame) -> DataFrame:
    """By rollout: fetches, ids a fetch, re-requests, recall and precision of key items. folded: with seen_before and fresh."""
    again = F.size(F.filter("call_ids", lambda i: F.array_contains("seen_before", i)))
    flat = F.array_distinct(F.flatten(F.collect_list("fresh")))
    out = folded.groupBy(*keys).agg(F.sum(F.col("call_ids").isNotNull().cast("int")).alias("fetches"), F.avg(F.size("call_ids").cast("double")).alias("ids_per_fetch"), F.coalesce(F.sum(again), F.lit(0)).alias("rerequested"), flat.alias("fetched"))
    hits = F.size(F.array_intersect("fetched", "key_ids"))
    joined = out.join(key_ids.select("case_id", "key_ids"), "case_id", "left")
    recall = F.when(F.size("key_ids") > 0, hits / F.size("key_ids"))
    precision = F.when((F.size("key_ids") > 0) & (F.size("fetched") > 0), hits / F.size("fetched"))
    return joined.select(*keys, "fetches", "ids_per_fetch", "rerequested", recall.alias("key_recall"), precision.alias("key_precision"))


def audit_requests(cases: DataFrame, messages: DataFrame, blind: bool = True) -> DataFrame:
    """(case_id, payload): what an auditor gets, a JSON object of exactly case_id, package and messages; only an audit that
    isn't blind also gets the reference. cases: case_id, package (JSON), reference; messages: case_id, pos, role, content."""
    said = F.transform(F.sort_array(F.collect_list(F.struct("pos", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    parts = ["case_id", F.try_parse_json("package").alias("package"), "messages", *([] if blind else ["reference"])]
    joined = cases.join(messages.groupBy("case_id").agg(said.alias("messages")), "case_id")
    return joined.select("case_id", F.to_json(F.struct(*parts)).alias("payload"))


STATE = ["Current hypotheses", "Hypothesis ledger"]


def _items_text(ids: Column, items: Column) -> Column:
    """`id | title | kind` and text of each id that the map of items knows."""
    one = lambda i: F.try_element_at(items, i)
    line = lambda i: F.when(one(i).isNull(), F.concat(i, F.lit(" | (no such item in the case)"))).otherwise(F.concat(F.concat_ws(" | ", i, F.coalesce(one(i)["title"], F.lit("")), F.coalesce(one(i)["kind"], F.lit(""))), F.lit("\n"), F.coalesce(one(i)["text"], F.lit(""))))
    return F.transform(ids, line)


def _titles(ids: Column, items: Column) -> Column:
    return F.transform(ids, lambda i: F.concat_ws(" | ", i, F.coalesce(F.try_element_at(items, i)["title"], F.lit("(no such item in the case)"))))


def _listed(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("(none)")


def _numbered(rows: DataFrame, keys: list[str], order: str, body: Column, head: Column, last: str) -> DataFrame:
    """keys, request, n_items: a head, the numbered bodies in order, and what to answer."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, body.alias("body")))), lambda s: s["body"])
    out = rows.groupBy(*keys).agg(listed.alias("_parts"), F.first(head).alias("_head"))
    numbered = F.transform("_parts", lambda p, i: F.concat(F.lit("# "), (i + 1).cast("string"), F.lit("\n"), p))
    return out.select(*keys, F.concat_ws("\n\n", "_head", F.array_join(numbered, "\n\n"), F.lit(last)).alias("request"), F.size("_parts").alias("n_items"))


def fetch_requests(folded: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """What a judge of requests is asked, one row a rollout with valid requests. The judge sees the reference's key items
    that were unread at each request, which the investigator doesn't; not what the items say.

    folded: keys, turn, assistant, call_ids, reason, seen_before, valid; cases: case_id, question, items (a map of id to
    title, kind, text), key_ids."""
    from evispark.functions.text import pick_sections

    rows = folded.where("valid").join(cases, "case_id")
    mark = lambda i: F.when(F.array_contains("seen_before", i), " | ALREADY READ").otherwise(" | NEW")
    asked = F.zip_with(_titles(F.col("call_ids"), F.col("items")), F.col("call_ids"), lambda line, i: F.concat(line, mark(i)))
    unread = _titles(F.sort_array(F.array_except("key_ids", "seen_before")), F.col("items"))
    body = F.concat(
        F.lit("## State at the moment of the request\n"), pick_sections("assistant", STATE), F.lit("\n\n## Already read\n"), F.when(F.size("seen_before") > 0, F.array_join(F.sort_array("seen_before"), ", ")).otherwise("(none)"),
        F.lit("\n\n## Requested\n"), _listed(asked), F.lit("\n\n## Stated reason\n"), F.coalesce("reason", F.lit("")), F.lit("\n\n## Key items still unread (not shown to the investigator)\n"), _listed(unread),
    )
    return _numbered(rows, keys, "turn", body, F.concat(F.lit("# Task question\n"), F.col("question")), "Answer for every request.")


def hypothesis_requests(turns: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """What a judge of updates is asked: the state before, the items just returned and the update; nothing of the reference.
    turns: keys, turn, assistant, call_ids, call_errors, fresh, return_error."""
    from evispark.functions.text import pick_sections

    w = Window.partitionBy(*keys).orderBy("turn")
    none = F.array().cast("array<string>")
    before = F.struct("assistant", F.col("call_ids").isNotNull().alias("called"), (F.size(F.coalesce("call_errors", none)) > 0).alias("erred"), F.coalesce("fresh", none).alias("fresh"), "return_error")
    pairs = turns.withColumn("_b", F.lag(before).over(w)).where(F.col("call_ids").isNotNull() & (F.col("_b.called") | F.col("_b.erred"))).join(cases, "case_id")
    returned = F.when(F.col("_b.return_error").isNotNull(), F.concat(F.lit("(the fetch failed: "), F.col("_b.return_error"), F.lit(")"))).when(~F.col("_b.called"), "(no tool result)").when(F.size("_b.fresh") == 0, "(no new evidence)").otherwise(F.array_join(_items_text(F.col("_b.fresh"), F.col("items")), "\n\n"))
    body = F.concat(F.lit("## State before\n"), pick_sections(F.col("_b.assistant"), STATE), F.lit("\n\n## Just returned\n"), returned, F.lit("\n\n## Update\n"), pick_sections("assistant", ["Evidence and hypothesis update", "Hypothesis ledger"]))
    return _numbered(pairs, keys, "turn", body, F.concat(F.lit("# Task question\n"), F.col("question")), "Answer for every update.")


def closure_requests(results: DataFrame, cases: DataFrame, keys: list[str], most: int = 6000) -> DataFrame:
    """What a judge of final answers is asked, for rollouts with a decision: the answer, the cited items in full, titles
    read and unread, and the reference. results: keys, final_answer, disclosed, marker; cases also: closure, official,
    teacher_final, alternatives."""
    from evispark.functions.text import evidence_ids, id_order

    rows = results.where("marker IS NOT NULL").join(cases, "case_id")
    cited = id_order(F.array_distinct(evidence_ids("final_answer")))
    flagged = F.zip_with(_items_text(cited, F.col("items")), cited, lambda text, i: F.when(F.array_contains("disclosed", i), text).otherwise(F.concat(text, F.lit("  [CITED BUT NEVER READ]"))))
    store = id_order(F.map_keys("items"))
    read, unread = F.filter(store, lambda i: F.array_contains("disclosed", i)), F.filter(store, lambda i: ~F.array_contains("disclosed", i))
    decision = lambda c: F.when(c == "closed", "CASE CLOSED").otherwise("CASE NOT CLOSED")
    official = F.when(F.length("official") > most, F.concat(F.substring("official", 1, most), F.lit(" [...]"))).otherwise(F.coalesce("official", F.lit("(none)")))
    last = F.when(F.col("marker") == "closed", "Score the conclusion; the gap must be null (the case was closed).").otherwise("Score the conclusion and the gap.")
    parts = {
        "Task question": F.col("question"), "Decision": decision(F.col("marker")), "Final answer": F.trim("final_answer"), "Cited items": F.when(F.size(flagged) > 0, F.array_join(flagged, "\n\n")).otherwise("(no citations)"),
        "Read": _listed(_titles(read, F.col("items"))), "Not read": _listed(_titles(unread, F.col("items"))),
        "Reference (not shown to the investigator)": F.concat_ws("\n\n", decision(F.col("closure")), F.coalesce("teacher_final", F.lit("(none)")), official, _listed(F.coalesce("alternatives", F.array().cast("array<string>")))),
    }
    return rows.select(*keys, F.concat_ws("\n\n", *[F.concat(F.lit(f"# {name}\n"), value) for name, value in parts.items()], last).alias("request"), F.lit(1).alias("n_items"))


def behaviour(turns: DataFrame, finals: DataFrame, key_ids: DataFrame, keys: list[str]) -> DataFrame:
    """What a rollout was like, in sixteen figures. turns: keys, turn, assistant, call_ids, call_errors, return_error,
    seen_before, fresh, gen_tokens; finals: keys, final_answer, citations_seen; key_ids: case_id, key_ids."""
    from evispark.functions.text import evidence_ids, sections

    none = F.array().cast("array<string>")
    stated = F.array_distinct(F.regexp_extract_all(F.coalesce(F.try_element_at(sections("assistant"), F.lit("Current hypotheses")), F.lit("")), F.lit(r"(?m)^\s*(H[0-9]+)\b"), F.lit(1)))
    first = Window.partitionBy(*keys).orderBy("turn")
    erred = (F.size(F.coalesce("call_errors", none)) > 0) | F.col("return_error").isNotNull()
    valid = F.col("call_ids").isNotNull() & ~erred
    each = turns.withColumn("_h", stated).withColumn("_known", F.coalesce(F.flatten(F.collect_list("_h").over(first.rowsBetween(Window.unboundedPreceding, -1))), none)).withColumn("_nth", F.row_number().over(first))
    each = each.withColumn("_new", F.when(F.col("_nth") > 1, F.size(F.array_except("_h", "_known"))).otherwise(0)).withColumn("_again", F.when(valid, F.size(F.filter("call_ids", lambda i: F.array_contains("seen_before", i)))).otherwise(0))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    tried = count(F.col("call_ids").isNotNull() | (F.size(F.coalesce("call_errors", none)) > 0))
    out = each.groupBy(*keys).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_h")))).alias("hypothesis_count"), F.max(F.size("_h")).alias("hypothesis_count_max_per_turn"), F.sum("_new").alias("new_hypotheses_after_turn1"),
        count(F.col("call_ids").isNotNull()).alias("fetches"), F.avg(F.size("call_ids").cast("double")).alias("ids_per_fetch"), F.sum("_again").alias("rerequested_items"), count(erred).alias("invalid_fetch_turns"),
        F.when(tried > 0, count(erred) / tried).otherwise(0.0).alias("invalid_format_rate"), F.avg(F.when(F.col("gen_tokens") > 0, F.col("gen_tokens"))).alias("tokens_per_turn"),
        F.array_distinct(F.flatten(F.collect_list(F.when(valid, F.col("call_ids"))))).alias("_fetched"),
    )
    moved = hypothesis_behaviour(turns, keys).select(*keys, F.col("ruled_out").alias("hypotheses_ruled_out"), F.col("switches").alias("leading_switches"))
    out = out.join(moved, keys, "left").fillna(0, ["hypotheses_ruled_out", "leading_switches"]).join(finals, keys, "left").join(key_ids, "case_id", "left")
    hits = F.size(F.array_intersect("_fetched", "key_ids"))
    known = F.coalesce(F.size("key_ids") > 0, F.lit(False))
    return (
        out.withColumn("key_recall", F.when(known, hits / F.size("key_ids"))).withColumn("key_precision", F.when(known & (F.size("_fetched") > 0), hits / F.size("_fetched")))
        .withColumn("final_answer_chars", F.length("final_answer")).withColumn("final_citations", F.size(F.array_distinct(evidence_ids("final_answer")))).withColumnRenamed("citations_seen", "citations_valid")
        .drop("_fetched", "key_ids", "final_answer")
    )
