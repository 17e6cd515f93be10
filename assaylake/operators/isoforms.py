"""Shares of isoforms from classes of reads, by a Metropolis sampler."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.ranks import dealt
from assaylake.sources.kept import kept

#: Genes that a task samples: some ten milliseconds each, of a few hundred bytes, so their bytes say nothing of a task's time.
GENES = 4096
#: Rounds that are thrown away and rounds that are kept, chains of an event, rounds between two changes of the step, events
#: sampled together.
BURN, ROUNDS, CHAINS, TUNE, TOGETHER = 300, 800, 8, 25, 128


def lengths(forms: DataFrame, read_length: int, overhang: int = 1) -> DataFrame:
    """(gene, isoform, length): the places at which a read of read_length can begin in an isoform (gene, isoform, exons), less those
    that would leave fewer than overhang bases beside a junction; 1 at least."""
    bases = F.aggregate("exons", F.lit(0).cast("long"), lambda acc, e: acc + (e["end"] - e["start"] + 1).cast("long"))
    lost = F.lit(read_length - 1) + (F.size("exons") - 1) * F.lit(2 * (overhang - 1))
    return forms.select("gene", "isoform", F.greatest(bases - lost, F.lit(1)).cast("long").alias("length"))


def _log_density(psi: np.ndarray, has: np.ndarray, n: np.ndarray, total: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of shares psi (isoforms, chains of all events): a read of a class comes from one of its isoforms (has: classes, isoforms, chains; n: its
    reads, total: the event's), any place of any molecule being as likely; a uniform prior, on the scale of the logits."""
    own, everywhere = has[:, 0] * psi[0], length[0] * psi[0]
    for j in range(1, len(psi)):
        own += has[:, j] * psi[j]
        everywhere += length[j] * psi[j]
    logs = np.log(np.maximum(own, 1e-300, out=own), out=own)
    logs *= n
    return logs.sum(axis=0) - total * np.log(everywhere) + np.log(np.maximum(psi, 1e-300)).sum(axis=0)


def _shares(logits: np.ndarray) -> np.ndarray:
    """(isoforms, chains) of logits of all isoforms but the last, whose logit is 0."""
    z = np.concatenate([logits, np.zeros((1, logits.shape[1]))])
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def chains(keys: list[str], has: np.ndarray, n: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Draws (events, rounds * chains, isoforms) from the posterior of each event's shares (has: events, classes, isoforms). An event's random
    numbers follow from its key alone, so it has the same draws wherever it is sampled. In the rounds thrown away each event's step
    follows how many of its moves are taken. The chains of all events are the last axis, the long one, of what a round computes."""
    e, k, rounds = len(keys), has.shape[2], BURN + ROUNDS
    moves, luck = np.empty((e, rounds, CHAINS, k - 1)), np.empty((e, rounds, CHAINS))
    for i, x in enumerate(keys):
        r = np.random.default_rng(np.frombuffer(hashlib.sha256(x.encode()).digest(), np.uint8).astype(np.uint32))
        r.standard_normal(out=moves[i])
        r.random(out=luck[i])
    moves = moves.transpose(1, 3, 0, 2).reshape(rounds, k - 1, e * CHAINS)
    with np.errstate(divide="ignore"):
        luck = np.log(luck, out=luck).transpose(1, 0, 2).reshape(rounds, e * CHAINS)
    each = lambda x: np.repeat(x, CHAINS, axis=-1)
    given = (each(has.transpose(1, 2, 0)), each(n.T), each(n.sum(axis=1)), each(length.T))
    at, wide = np.zeros((k - 1, e * CHAINS)), np.ones(e * CHAINS)
    psi = _shares(at)
    now = _log_density(psi, *given)
    step, taken, out = np.full(e, 1.0), np.zeros(e), np.empty((ROUNDS, k, e * CHAINS))
    for i in range(rounds):
        to = at + moves[i] * wide
        near = _shares(to)
        then = _log_density(near, *given)
        go = luck[i] < then - now
        for old, new in ((at, to), (psi, near), (now, then)):
            np.copyto(old, new, where=go)
        if i < BURN:
            taken += go.reshape(e, CHAINS).mean(axis=1)
            if i % TUNE == TUNE - 1:
                step *= np.exp(2 * (taken / TUNE - 0.35))
                wide, taken[:] = each(step), 0
        else:
            out[i - BURN] = psi
    return out.reshape(ROUNDS, k, e, CHAINS).transpose(2, 0, 3, 1).reshape(e, ROUNDS * CHAINS, k)


def posterior(classes: DataFrame, sizes: DataFrame, level: float = 0.95, keep_draws: bool = True) -> DataFrame:
    """(gene, isoform, psi, low, high, reads, draws; keep_draws: else they stay in the task that makes them) of read classes (gene, isoforms, reads) and isoforms' lengths (gene, isoform,
    length): the mean share, its credible interval of that level, the gene's reads, and the draws.

    Genes without a read are left out, isoforms that no length is given for as well; a gene with one isoform has share 1. The classes of
    a gene are one row, and rows are sampled some together, so tasks share the genes evenly whatever their reads."""
    forms = sizes.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("isoform", "length"))).alias("forms"))
    found = classes.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("isoforms", "reads"))).alias("classes"))
    kind = dict(classes.dtypes)["gene"]
    columns = ["gene", "isoform", "psi", "low", "high", "reads", *(["draws"] if keep_draws else [])]

    def some(part: pd.DataFrame) -> pd.DataFrame:
        names = [[f["isoform"] for f in x] for x in part["forms"]]
        has = np.array([[[float(i in set(c["isoforms"])) for i in own] for c in x] for own, x in zip(names, part["classes"], strict=True)])
        n = np.array([[float(c["reads"]) if m.any() else 0.0 for c, m in zip(x, h, strict=True)] for x, h in zip(part["classes"], has, strict=True)])
        length = np.array([[float(f["length"]) for f in x] for x in part["forms"]])
        if has.shape[2] == 1:
            draws = np.ones((len(part), 1, 1))
        else:
            draws = chains([str(g) for g in part["gene"]], has, n, length)
        low, high = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2], axis=1)
        mean, rows = draws.mean(axis=1), []
        for e, gene in enumerate(part["gene"]):
            rows += [(gene, i, mean[e, j], low[e, j], high[e, j], int(n[e].sum()), draws[e, :, j]) for j, i in enumerate(names[e])]
        return pd.DataFrame(rows, columns=["gene", "isoform", "psi", "low", "high", "reads", "draws"])[columns]

    def sample(frames):
        for frame in frames:
            shape = [(len(f), len(c)) for f, c in zip(frame["forms"], frame["classes"], strict=True)]
            for _, same in frame.groupby(pd.Series(shape, index=frame.index)):
                for a in range(0, len(same), TOGETHER):
                    yield some(same.iloc[a : a + TOGETHER])

    events = kept(found.join(forms, "gene"))
    return dealt(events, ["gene"], GENES).mapInPandas(sample, f"gene {kind}, isoform string, psi double, low double, high double, reads long" + ", draws array<double>" * keep_draws)


def sampled(classes: DataFrame, sizes: DataFrame, level: float = 0.95) -> DataFrame:
    """posterior without its draws."""
    return posterior(classes, sizes, level, keep_draws=False)


def paired_draws(one: DataFrame, two: DataFrame) -> DataFrame:
    """(feature, one, two): draws of two posteriors side by side, by gene and isoform, as hypothesis.bayes_factor takes them."""
    key = F.concat(F.col("gene").cast("string"), F.lit(":"), "isoform").alias("feature")
    side = lambda x, name: x.select(key, F.posexplode("draws").alias("_i", name))
    return side(one, "one").join(side(two, "two"), ["feature", "_i"]).select("feature", "one", "two")


def passing(pairs: DataFrame, least_sum: int, least_own: int, least_other: int, delta: float, factor: float) -> DataFrame:
    """Of pairs (inclusion, exclusion: reads of each sample as arrays; dpsi, bayes_factor) those with enough reads in either sample
    (together, included and excluded) and a change and a factor that are large enough."""
    enough = lambda x: (x["inclusion"] + x["exclusion"] >= least_sum) & (x["inclusion"] >= least_own) & (x["exclusion"] >= least_other)
    both = F.exists(F.arrays_zip("inclusion", "exclusion"), enough)
    return pairs.where(both & (F.abs("dpsi") >= delta) & (F.col("bayes_factor") >= factor))
