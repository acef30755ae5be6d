"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Tokens are summed into cells of source, language and topic. Rounds of fitting scale the cells' weights until each margin has its
target share. A document is kept with the probability budget * (fitted / observed) of its cell, decided by a hash of its id.

Fitting is bounded: a cell cannot give more than all of its documents, so its fitted share is at most observed / budget. Each step scales
what is not saturated to what the saturated cells leave of the margin, and a value that has fewer tokens
than its target asks for is kept whole, its surplus shared by the others of its dimension. So the sample has the budget, whatever its
smallest cell holds. ``exact`` fits until the margins hold, instead of for a number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, whole

DIMENSIONS = ("source", "lang", "topic")
#: Where no target is given, a value's share is in proportion to its tokens to this power.
ALPHA = 0.7
ROUNDS, BUDGET, SEED = 10, 0.5, "mix-1"
#: Up to so many cells are fitted in one task and broadcast; more are fitted over all tasks and joined by shuffling.
SMALL_CELLS = 20_000
#: Exact fits end when no margin is off its target by TOLERANCE, or when WHILE more rounds bring it no closer: then the cells that occur
#: cannot have the targets.
TOLERANCE, WHILE = 1e-6, 32

_TOPICS = (("notice", "icense"), ("contact", "@"), ("tabular", " | "))


def with_topic(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words) and topic, by what the text holds; of several, the first of notice, contact, tabular, numeric, prose."""
    t = whole(text)
    topic = F
    for name, sign in _TOPICS:
        topic = topic.when(t.contains(sign), name)
    topic = topic.when(t.rlike("[0-9][0-9][0-9][0-9]"), "numeric").otherwise("prose")
    return docs.withColumns({"n_tokens": F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), "topic": topic})


def _scaled(x: str, cap: str, to: str, by: str) -> str:
    """SQL of a step: ``x`` scaled so that over each ``by`` what is under ``cap`` and the caps of the rest sum to ``to``. Saturated rows
    are scaled too, and may fall under their cap again; where caps alone are over ``to`` all are scaled down, where no row is under its cap none is."""
    full = f"{x} >= {cap} * 0.999999999D"  # what comes to its cap by rounding is full in any engine
    held = f"coalesce(sum(case when {full} then {cap} end) over (partition by {by}), 0)"
    free = f"coalesce(sum(case when not ({full}) then {x} end) over (partition by {by}), 0)"
    return f"{x} * case when {held} >= {to} then {to} / ({held} + {free}) when {free} > 0 then ({to} - {held}) / {free} else 1.0D end"


def _filled(x: str, cap: str) -> tuple[str, str]:
    """SQL of what ``_bounded`` does, in two steps over a table with a constant ``one``: _g, the sum if the scale were the one at which the
    row is full, and then the scaled ``x``."""
    whole_, rows = "partition by one", f"partition by one order by {cap} / {x} rows between unbounded preceding and current row"
    g = f"sum({cap}) over ({rows}) + {cap} / {x} * greatest(0, sum({x}) over ({whole_}) - sum({x}) over ({rows}))"
    free, held = f"sum(case when _g > 1 then {x} end) over ({whole_})", f"coalesce(sum(case when _g <= 1 then {cap} end) over ({whole_}), 0)"
    return g, f"{x} * coalesce((1 - {held}) / nullif({free}, 0), max({cap} / {x}) over ({whole_}))"


def _bounded(margin: DataFrame) -> DataFrame:
    """``margin`` with its ``share`` bounded by ``cap``; what that leaves goes to the other values, in proportion."""
    scale = 1.0
    while True:
        full = F.col("cap") <= scale * F.col("share")
        held, free = margin.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("share")))).first()
        now = (1.0 - (held or 0.0)) / free if free else scale
        if now <= scale * (1 + 1e-15):
            return margin.withColumn("share", F.least("cap", scale * F.col("share")))
        scale = now


def fitted_cells(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, budget: float = BUDGET, exact: bool = False) -> DataFrame:
    """(source, lang, topic, tokens, fitted, probability), a row a cell; a null value is the value ''.

    ``targets`` may give shares for values of a dimension; its other values share what is left, by tokens to the power ``alpha``.
    All margins' targets are over values that occur. ``fitted`` is the cell's share of the sample's tokens, and at most
    tokens / (all tokens * ``budget``), which is the probability 1; a value's target is at most the sum of that over its cells. Cells
    without tokens have fitted 0 and the probability ``budget``. ``exact``: ``rounds`` at least, as many as the margins need.
    """
    cells = docs.groupBy(*(F.coalesce(F.col(d), F.lit("")).alias(d) for d in DIMENSIONS)).agg(F.sum("n_tokens").alias("tokens"))
    cells = cut(cells)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    for d in DIMENSIONS:
        given = (targets or {}).get(d, {})
        margin = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("t"))
        power = F.when(F.col("t") > 0, F.pow(F.col("t"), F.lit(float(alpha)))).otherwise(0.0)
        if given:
            power = F.when(F.col(d).isin(list(given)), 0.0).otherwise(power)
        margin = cut(margin.withColumn("p", power))
        rest = margin.agg(F.sum("p")).first()[0] or 0.0
        share = F.col("p") * ((1.0 - sum(given.values())) / rest if rest else 0.0)
        for value, x in given.items():
            share = F.when(F.col(d) == value, F.lit(float(x))).otherwise(share)
        margin = _bounded(margin.select(d, share.alias("share"), (F.col("t") / (total * budget)).alias("cap")))
        cells = cells.join(margin.select(d, F.col("share").alias(f"_{d}")), d)
    cells = cut(cells)
    count = cells.count()
    empty = cells.filter("tokens = 0").select(*DIMENSIONS, "tokens", F.lit(0.0).alias("fitted"), F.lit(float(budget)).alias("probability"))
    w = cells.filter("tokens > 0")
    w = w.coalesce(1) if count <= SMALL_CELLS else w
    w = w.withColumn("_x", F.col("tokens").cast("double") / total).withColumn("_cap", F.col("_x") / budget)

    def fit(w: DataFrame, rounds: int) -> DataFrame:
        for i in range(rounds):
            for d in DIMENSIONS:
                w = w.withColumn("_x", F.expr(_scaled("_x", "_cap", f"_{d}", d)))
            # a task holds a page for each sort that waits in it
            w = cut(w) if i % 5 == 4 else w
        return w.withColumn("fitted", F.least("_x", "_cap"))

    w = fit(w, rounds)
    if exact:
        w, least, since = cut(w), float("inf"), 0
        while (off := _off(w)) > TOLERANCE and since < WHILE:
            since = 0 if off < 0.99 * least else since + rounds
            least = min(least, off)
            w = cut(fit(w, rounds))
    w = w.withColumn("probability", F.round(F.least(F.lit(1.0), F.try_divide("fitted", "_cap")), 9))
    return w.select(*DIMENSIONS, "tokens", "fitted", "probability").union(empty)


def _off(cells: DataFrame) -> float:
    """The most by which a margin is off its target."""
    off = [cells.groupBy(d).agg(F.abs(F.sum("fitted") - F.first(f"_{d}")).alias("x")).agg(F.max("x")).first()[0] for d in DIMENSIONS]
    return max((x for x in off if x is not None), default=0.0)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, budget: float = BUDGET, seed: str = SEED, exact: bool = False) -> DataFrame:
    """``docs`` with n_tokens, topic, probability and kept.

    ``docs`` needs doc_id, text, source and lang; columns of the new names are replaced. A null text has no tokens; a null source or
    language counts as ''. Rows that repeat a doc_id in one cell are kept or not together; a null doc_id is decided as ''.
    """
    docs = with_topic(docs)
    cells = cut(fitted_cells(docs, targets, alpha, rounds, budget, exact))
    small = cells.count() <= SMALL_CELLS
    docs = docs.drop("probability", "kept")
    of = {d: fresh(docs, f"_cell_{d}") for d in DIMENSIONS}
    cells = cells.select(*(F.col(d).alias(of[d]) for d in DIMENSIONS), "probability")
    on = [F.coalesce(F.col(d), F.lit("")) == F.col(of[d]) for d in DIMENSIONS]
    df = docs.join(F.broadcast(cells) if small else cells, on, "left").drop(*of.values())
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    return df.withColumn("kept", drawn.cast("double") / float(16**12) < F.col("probability"))


def sql(documents: str = "documents", alpha: float = ALPHA, rounds: int = ROUNDS, budget: float = BUDGET, seed: str = SEED) -> str:
    """The same in DuckDB, without explicit targets, as common table expressions that end in m_out (documents' columns and the new ones)."""
    topic = "case " + " ".join(f"when contains(t, '{sign}') then '{name}'" for name, sign in _TOPICS) + " when regexp_matches(t, '[0-9][0-9][0-9][0-9]') then 'numeric' else 'prose' end"
    out = [
        f"m_d as (select *, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens, {topic} as topic from (select *, coalesce(text, '') as t from {documents}))",
        "m_c as materialized (select coalesce(source, '') as source, coalesce(lang, '') as lang, topic, sum(n_tokens)::bigint as tokens from m_d group by all)",
    ]
    for d in DIMENSIONS:
        out.append(f"m_{d}0 as (select {d}, sum(tokens)::double as t, case when sum(tokens) > 0 then pow(sum(tokens)::double, {alpha}) else 0 end as p from m_c group by {d})")
        out.append(f"m_{d}1 as (select {d}, 1 as one, p / sum(p) over () as x, t / (sum(t) over () * {budget}) as cap from m_{d}0 where t > 0)")
        g, x = _filled("x", "cap")
        out.append(f"m_{d}2 as (select *, {g} as _g from m_{d}1)")
        out.append(f"m_{d} as materialized (select {d}, least(cap, {x}) as share from m_{d}2)")
    out.append(
        f"w_0 as (select m_c.*, tokens / sum(tokens::double) over () as x, tokens / (sum(tokens::double) over () * {budget}) as cap, " + ", ".join(f"m_{d}.share as _{d}" for d in DIMENSIONS)
        + " from m_c " + " ".join(f"join m_{d} using ({d})" for d in DIMENSIONS) + " where tokens > 0)"
    )
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            out.append(f"w_{n + 1} as materialized (select * exclude (x), {_scaled('x', 'cap', f'_{d}', d).replace('1.0D', '1.0::double').replace('0.999999999D', '0.999999999::double')} as x from w_{n})")
            n += 1
    out.append(f"m_p as materialized (select source, lang, topic, round(least(1.0, least(x, cap) / cap), 9) as probability from w_{n} union all select source, lang, topic, {budget}::double from m_c where tokens = 0)")
    out.append(
        f"m_out as (select m_d.* exclude (t), probability, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint::double / {float(16**12)!r} < probability as kept"
        " from m_d left join m_p on coalesce(m_d.source, '') = m_p.source and coalesce(m_d.lang, '') = m_p.lang and m_d.topic = m_p.topic)"
    )
    return ",\n".join(out)


SQL = "with " + sql() + " select doc_id, topic, n_tokens, probability, kept from m_out"
