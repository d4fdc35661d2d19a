"""Rules that decide a cell of the evaluation: columns of nullable structs, the first that fires wins.

A cell has ``outcome`` (pass, fail, undetermined, missing), ``doubt`` (why it is undetermined, or empty), ``complete`` (every page
was read), ``cited`` (a quote of the bid supports it) and the facts that a rule names. A rule gives null where it doesn't apply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

c = F.col
DECIDED = ("pass", "fail")


def verdict(outcome: str | Column, doubt: str | Column, rule: str, ask: bool | Column = False) -> Column:
    """What a rule leaves: the outcome, the doubt, the rule's name and whether the committee is asked."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(column(outcome).alias("outcome"), column(doubt).alias("doubt"), F.lit(rule).alias("rule"), column(ask).alias("ask"))


def kept(rule: str) -> Column:
    """The cell as it is, with the rule's name."""
    return verdict(c("outcome"), c("doubt"), rule)


def guarantee_form() -> Column:
    """Not applicable (a pass) if the bid chose forms of guarantee and none is a required one. required_forms, chosen_forms: arrays."""
    fires = (F.size("required_forms") > 0) & (F.size("chosen_forms") > 0) & ~F.arrays_overlap("required_forms", "chosen_forms")
    return F.when(fires, verdict("pass", "", "guarantee_form"))


def option() -> Column:
    """A requirement of an option that the bid doesn't use: not applicable, if its quote is located and all was read; doubtful use is asked.

    option (null: none), located, option_shown, option_use (yes, no, unknown), option_unsure.
    """
    stands = c("option").isNotNull() & c("complete") & c("located") & ~c("option_shown") & (c("option_use") != "yes")
    return F.when(stands & c("option_unsure"), verdict("undetermined", "no_data", "option_unsure", True)).when(stands, verdict("pass", "", "option"))


def marked_option() -> Column:
    """A row without an option that every reading marked as one that isn't used: asked, never decided. concluded: some reading concluded."""
    fires = (
        c("option").isNull()
        & (c("option_use") == "no")
        & (c("category") != "technical")
        & c("outcome").isin("undetermined", "missing")
        & c("doubt").isin("", "no_data")
        & ~c("option_shown")
        & ~c("concluded")
    )
    return F.when(fires, verdict("undetermined", "no_data", "option_marked", True))


def presentation() -> Column:
    """A thing to hand in on paper of which nothing is quoted though all was read: asked if a circular or the portal touches it,
    else a fail where its form applies. physical, touched, marked, form_applies (null: not known)."""
    stands = c("physical") & ~c("cited") & c("complete")
    return (
        F.when(stands & c("touched"), verdict("undetermined", "no_data", "presentation_circular", True))
        .when(stands & c("marked"), verdict("undetermined", "no_data", "presentation_mark", True))
        .when(stands & F.coalesce(c("form_applies"), F.lit(False)), verdict("fail", "", "presentation_missing"))
    )


def external() -> Column:
    """A check that others make waits for their sheet. external (the text names such a check), has_sheet."""
    fires = (c("external") | (c("doubt") == "external")) & ~c("has_sheet")
    return F.when(fires, verdict("undetermined", "external", "external"))


def technical() -> Column:
    """A technical row: the committee's ok decides; else a missing document stays missing, anything else is pending. ok_verdict, has_document."""
    own = c("category") == "technical"
    no_document = ~c("has_document") & (c("outcome") == "missing")
    return (
        F.when(own & c("ok_verdict").isNotNull(), verdict(F.when(c("ok_verdict") == "fit", "pass").otherwise("fail"), "", "technical_ok"))
        .when(own & no_document, verdict("missing", "", "technical"))
        .when(own, verdict("undetermined", "pending", "technical"))
    )


def line_quoted() -> Column:
    """Whether a technical row's line has an offer: yes if quoted or cited, no if all was read and nothing found, else unknown. quoted, nothing_found."""
    return F.when(c("quoted") | c("cited"), "yes").when(c("complete") & c("nothing_found"), "no").otherwise("unknown")


def unreadable() -> Column:
    """An open cell that a page which can't be read may answer. unreadable (own), reached (another cell's page of the same kind)."""
    open_ = ~c("outcome").isin(*DECIDED) & (c("doubt") != "contradiction")
    return F.when(open_ & (c("unreadable") | c("reached")), verdict("undetermined", "unreadable", "unreadable", True))


def portal_value() -> Column:
    """The portal's value against what is required and what the bid says.

    asked (the requirement asks for a value that the portal has), offered (the bid names values), matching (one is the portal's),
    compared: not_asked, not_comparable, partial, equal, different; conditions and pending (of the reading), asks_more.
    """
    asked, state = c("asked"), c("compared")
    mismatch = verdict("undetermined", "mismatch", "portal_mismatch", True)
    open_reason = (c("outcome") == "undetermined") & (~c("doubt").isin("", "no_data") | ((c("conditions") > 0) & (c("pending") == 0)))
    none = F.when(F.lit(False), mismatch)
    not_comparable = (
        F.when(c("outcome").isin(*DECIDED), kept("portal_both"))
        .when(open_reason, kept("portal_both"))
        .when(c("conditions") > 0, verdict("undetermined", "no_data", "portal_partial", True))
        .otherwise(mismatch)
    )
    equal = (
        F.when(c("outcome") == "fail", mismatch)
        .when(c("asks_more") & (c("outcome") == "pass"), kept("portal_both"))
        .when(c("asks_more") | (c("pending") > 0), verdict("undetermined", "no_data", "portal_partial", True))
        .otherwise(verdict("pass", "", "portal_pass"))
    )
    different = F.when((c("outcome") == "pass") & ~c("matching"), mismatch).otherwise(verdict("fail", "", "portal_fail"))
    return F.when(
        asked,
        F.when(c("offered") & ~c("matching"), mismatch)
        .when(state == "not_asked", none)
        .when(state == "not_comparable", not_comparable)
        .when(state == "partial", mismatch)
        .when(state == "equal", equal)
        .otherwise(different),
    )


def absence() -> Column:
    """Nothing found counts as a pass for a closed list of phrasings only: all read, every condition open and without quote, value or conclusion.

    by_absence (the text and each condition are on the list), conditions, evidence (conditions with a quote, value or conclusion), exigence.
    """
    fires = (
        c("outcome").isin("undetermined", "missing")
        & c("doubt").isin("", "no_data")
        & c("by_absence")
        & c("complete")
        & ~c("cited")
        & (c("conditions") > 0)
        & (c("evidence") == 0)
        & (c("exigence") == "condition")
    )
    return F.when(fires, verdict("pass", "", "absence"))


#: The rules in the order in which they are asked.
RULES = (guarantee_form, option, presentation, external, technical, unreadable, portal_value, absence, marked_option)


def applied(cells: DataFrame) -> DataFrame:
    """cells with the verdict of the first rule that fires in place of outcome and doubt; rule is null where none does."""
    first = F.coalesce(*[rule() for rule in RULES])
    out = cells.withColumn("__v", first)
    changed = lambda k: F.coalesce(c(f"__v.{k}"), c(k))
    return out.withColumns({"outcome": changed("outcome"), "doubt": changed("doubt"), "rule": c("__v.rule"), "ask": F.coalesce(c("__v.ask"), F.lit(False))}).drop("__v")


def reach_of_unreadable(cells: DataFrame, by: str, kind: str) -> DataFrame:
    """cells with reached: another cell of the same bid and kind names an unreadable page. One row a bid and kind joins back."""
    pages = cells.where(c("unreadable") & c(kind).isNotNull()).select(by, kind).distinct().withColumn("reached", F.lit(True))
    return cells.join(pages, [by, kind], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))


def combined(groups: DataFrame, by: list[str], order: str) -> DataFrame:
    """One outcome of what several groups of documents say of a requirement.

    groups: result (pass, fail, undetermined, silent), doubt, exigence, option_use, found, external, complete, explanation.
    """
    r = c("result")
    has = lambda x: F.bool_or(r == x)
    first = F.min_by("explanation", F.when(F.coalesce(c("explanation"), F.lit("")) != "", c(order)))
    doubtful = r == "undetermined"
    sums = groups.groupBy(*by).agg(
        has("pass").alias("p"), has("fail").alias("f"), has("undetermined").alias("u"), F.bool_or("external").alias("x"),
        F.bool_and("complete").alias("all_read"), F.bool_or(doubtful & (c("doubt") == "no_data")).alias("no_data"),
        F.bool_and(F.when(doubtful, c("doubt") == "no_citation")).alias("uncited"), F.bool_and(c("exigence") == "document").alias("document"),
        F.bool_or(c("option_use") == "no").alias("unused"), F.bool_or("found").alias("seen"), first.alias("explanation"), F.count("*").alias("groups"),
    )
    case = lambda outcome, doubt: F.struct(F.lit(outcome).alias("outcome"), F.lit(doubt).alias("doubt"))
    doubt = lambda d: F.when(c("all_read"), case("undetermined", d)).otherwise(case("undetermined", "incomplete"))
    ladder = (
        F.when(c("x"), case("undetermined", "external"))
        .when(c("p") & c("f"), case("undetermined", "contradiction"))
        .when((c("p") | c("f")) & c("u"), doubt("doubt"))
        .when(c("p"), case("pass", ""))
        .when(c("f"), case("fail", ""))
        .when(c("u") & c("no_data"), case("undetermined", "no_data"))
        .when(c("u") & c("uncited"), case("undetermined", "no_citation"))
        .when(c("u"), doubt("doubt"))
        .when(c("all_read") & c("document") & ~c("unused") & ~c("seen"), case("missing", ""))
        .when(~c("all_read"), case("undetermined", "incomplete"))
        .otherwise(case("undetermined", "no_data"))
    )
    return sums.withColumn("__v", ladder).select(*by, c("__v.outcome").alias("outcome"), c("__v.doubt").alias("doubt"), "explanation", "groups")


def two_votes() -> Column:
    """Where a row goes by two votes. a: keep, discard, doubt or null; b: yes, no, doubt or null; supported; motive_optional, of_option."""
    a, b = c("a"), c("b")
    only = F.coalesce(a, b)
    to = lambda d, why: F.struct(F.lit(d).alias("destination"), (why if isinstance(why, Column) else F.lit(why)).alias("why"))
    differs = F.when(b == "no", "disagree").otherwise("doubt")
    return (
        F.when(a.isNull() & b.isNull(), to("kept", "no_opinion"))
        .when((a.isNull() | b.isNull()) & only.isin("keep", "yes"), to("kept", "one_opinion"))
        .when(a.isNull() | b.isNull(), to("suggested", "one_opinion"))
        .when(a == "doubt", to("suggested", "doubt"))
        .when((a == "keep") & (b == "yes"), to("kept", ""))
        .when(a == "keep", to("suggested", differs))
        .when(~c("supported"), to("suggested", "unsupported"))
        .when(c("motive_optional") & c("of_option"), to("suggested", "disagree"))
        .when(b == "no", to("discarded", "motive"))
        .otherwise(to("suggested", F.when(b == "yes", "disagree").otherwise("doubt")))
    )


def failing(rules: dict[str, Column]) -> Column:
    """The names of the rules of integrity that a row breaks, in order; a rule that is unknown for a row isn't broken."""
    broken = [F.when(~rule, F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*broken)) if broken else reduce(lambda a, _: a, [], F.array().cast("array<string>"))
