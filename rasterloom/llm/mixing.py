"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). Categories that the targets do not name fall together as "other", so there are at most as many
cells as the targets, a parameter, allow; only those go to the driver. There the probabilities of the cells are raked in turn to each of the three
marginals of the wanted token mass, never above one, until all hold. Documents are then sampled by their cell's probability, with a uniform number that
is a hash of the id: the same documents at any partitioning and after any loss.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own

#: Cells that a call may have at most; more named categories than that need a coarser grouping.
MOST_CELLS = 1 << 18
OTHER = "other"


@dataclass(frozen=True)
class Targets:
    """Shares of the tokens by category; what is left to 1 goes to all categories that are not named."""

    source: dict[str, float] = field(default_factory=dict)
    language: dict[str, float] = field(default_factory=dict)
    topic: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        for name, shares in (("source", self.source), ("language", self.language), ("topic", self.topic)):
            if min(shares.values(), default=0) < 0 or sum(shares.values()) > 1 + 1e-9:
                raise ValueError(f"the {name} shares are not shares: {shares}")
        if (len(self.source) + 1) * (len(self.language) + 1) * (len(self.topic) + 1) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} cells")


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def form_topic(words: Column) -> Column:
    """A topic for tables without one: the form of the text by its length."""
    return F.when(words < 100, "note").when(words < 1000, "article").otherwise("chapter")


def _key(column: Column, shares: dict[str, float]) -> Column:
    names = [n for n in shares if n != OTHER]
    return F.when(column.isin(names), column).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)


def _wanted(shares: dict[str, float], names: np.ndarray, tokens: np.ndarray) -> dict[str, float]:
    """Shares of the categories that have tokens: those without give theirs to the others in proportion."""
    full = dict(shares)
    full[OTHER] = full.get(OTHER, 0.0) + max(0.0, 1 - sum(shares.values()))
    there = {n: full.get(n, 0.0) for n in dict.fromkeys(names.tolist()) if tokens[names == n].sum() > 0}
    total = sum(there.values())
    return {n: x / total if total else 1 / len(there) for n, x in there.items()}


def raked(cells: list[tuple[str, str, str, int]], targets: Targets, budget: float, rounds: int = 1000, close: float = 1e-9) -> np.ndarray:
    """Inclusion probabilities of the cells: token mass budget * all tokens, split as the targets say as far as no probability exceeds one."""
    keys = [np.array([c[i] for c in cells], object) for i in range(3)]
    tokens = np.array([c[3] for c in cells], float)
    p, mass = np.full(len(cells), float(budget)), budget * tokens.sum()
    wanted = [_wanted(s, k, tokens) for s, k in zip((targets.source, targets.language, targets.topic), keys)]
    for _ in range(rounds):
        before = p.copy()
        for names, shares in zip(keys, wanted):
            for name, share in shares.items():
                at = np.flatnonzero((names == name) & (tokens > 0))
                aim = min(share * mass, tokens[at].sum())
                for _ in range(60):  # cells at one leave their part to the others of the category
                    have = (tokens[at] * p[at]).sum()
                    free = at[p[at] < 1]
                    at_one = have - (tokens[free] * p[free]).sum()
                    if not len(free) or have <= 0 or abs(have - aim) <= close * max(aim, 1):
                        if aim < at_one:
                            p[at] *= aim / have if have else 0
                        break
                    if aim < at_one:
                        p[at] *= aim / have
                    else:
                        p[free] = np.minimum(1, p[free] * (aim - at_one) / max((tokens[free] * p[free]).sum(), 1e-300))
        if np.abs(p - before).max(initial=0) <= close:
            break
    return p


def shortfall(cells: list[tuple[str, str, str, int]], p: np.ndarray, targets: Targets, budget: float) -> list[tuple[str, str, float, float]]:
    """(marginal, category, wanted share, reached share) of the categories that miss their share of budget * all tokens by over a hundredth of it."""
    tokens = np.array([c[3] for c in cells], float)
    mass, out = budget * tokens.sum(), []
    for i, (name, shares) in enumerate((("source", targets.source), ("language", targets.language), ("topic", targets.topic))):
        keys = np.array([c[i] for c in cells], object)
        for category, wanted in _wanted(shares, keys, tokens).items():
            reached = float((tokens * p)[keys == category].sum() / mass) if mass else wanted
            if abs(reached - wanted) > 0.01 * max(wanted, 1e-9):
                out.append((name, category, wanted, reached))
    return out


def mixing_weights(docs: DataFrame, targets: Targets, budget: float, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, prefix: str = "") -> DataFrame:
    """docs with n_tokens, source_key, language_key, topic_key, weight (probability over budget), probability and sampled, each name after `prefix`.

    A null text has no tokens; null or unnamed categories count as "other"; documents of cells without tokens have the budget as their probability. Ties do
    not arise: rows with one id share their uniform number, and a repeated row is sampled or left with its twin. An empty table gives an empty result. A column of docs that
    has one of these names already is kept under its name and "_of_row". Shares that can't be met, as no probability exceeds one, are a warning.
    """
    if not 0 < budget <= 1:
        raise ValueError("budget is a share of the tokens")
    c = {n: f"{prefix}{n}" for n in ("n_tokens", "source_key", "language_key", "topic_key", "weight", "probability", "sampled")}
    mine, before = {x.lower() for x in c.values()}, {x.lower() for x in docs.columns}
    for name in [x for x in docs.columns if x.lower() in mine]:
        other = f"{name}_of_row"
        while other.lower() in mine | before:
            other += "_"
        docs = docs.withColumnRenamed(name, other)
        before.add(other.lower())
        id_col, text_col, source_col, lang_col = (other if x == name else x for x in (id_col, text_col, source_col, lang_col))
    o = own(docs)
    counted = docs.withColumn(c["n_tokens"], word_count(text_col))
    form = topic if topic is not None else form_topic(F.col(f"`{c['n_tokens']}`"))
    keyed = counted.withColumns({c["source_key"]: _key(F.col(f"`{source_col}`"), targets.source), c["language_key"]: _key(F.col(f"`{lang_col}`"), targets.language), c["topic_key"]: _key(form, targets.topic)})
    names = [c["source_key"], c["language_key"], c["topic_key"]]
    cells = [tuple(r) for r in keyed.groupBy(*names).agg(F.sum(c["n_tokens"])).collect()]  # at most MOST_CELLS
    p = raked(cells, targets, budget)
    if missed := shortfall(cells, p, targets, budget):
        warnings.warn("shares that the tokens there are can't give: " + "; ".join(f"{m} {k}: {r:.3f} of {w:.3f}" for m, k, w, r in missed), stacklevel=2)
    if cells:
        rates = docs.sparkSession.createDataFrame([(*x[:3], float(y)) for x, y in zip(cells, p)], f"{o('s')} string, {o('l')} string, {o('t')} string, {o('p')} double")
        keyed = keyed.join(F.broadcast(rates), (F.col(names[0]) == F.col(o("s"))) & (F.col(names[1]) == F.col(o("l"))) & (F.col(names[2]) == F.col(o("t"))), "left")
    else:
        keyed = keyed.withColumn(o("p"), F.lit(float(budget)))
    even = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = keyed.withColumns({c["weight"]: F.col(o("p")) / budget, c["probability"]: F.col(o("p")), c["sampled"]: even < F.col(o("p"))})
    return out.select(*(F.col(f"`{x}`") for x in [*docs.columns, *c.values()]))


def mixing_sample(docs: DataFrame, targets: Targets, budget: float, **options) -> DataFrame:
    """The sampled rows of docs, with their columns."""
    o = own(docs)
    found = mixing_weights(docs, targets, budget, prefix=o("mixing_"), **options)
    return found.where(F.col(o("mixing_sampled"))).select(*(F.col(f"`{c}`") for c in docs.columns))
