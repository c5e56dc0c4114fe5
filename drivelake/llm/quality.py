"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, windows, word_hashes, work_folder

_WS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, "
    "n_letters long, n_upper long, n_chars_seen long, n_distinct_words long, n_ended_lines long, n_exclaims long"
)


def _repeated_words(h: np.ndarray, k: int = 5) -> int:
    """Words inside windows of k words that occur twice or more in the text."""
    w = windows(h, k)
    if len(w) < 2:
        return 0
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    depth = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + k, minlength=len(h) + 1)
    return int((np.cumsum(depth) > 0).sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts named in FEATURES over one whole text. Null counts as empty."""
    text = text or ""
    h = word_hashes(text.encode("utf-8", "surrogatepass"))
    seen: set[str] = set()
    n_lines = n_dup = n_ended = 0
    for line in text.split("\n"):
        body = line.strip(_WS)
        if body:
            n_lines += 1
            n_ended += body[-1] in ".!?\"”»…"
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    white = sum(text.count(c) for c in _WS)
    lower = text.lower()
    # Letters with case: those that one of the two forms changes.
    n_upper = sum(map(str.isupper, text)) if lower != text else 0
    n_letters = sum(map(str.isalnum, text))  # and digits
    return (
        len(h), len(text) - white, sum(text.count(c) for c in _SYMBOLS), n_lines, n_dup, _repeated_words(h),
        n_letters, n_upper, len(text), len(np.unique(h)), n_ended, text.count("!"),
    )


def with_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its key and the counts of FEATURES."""
    kind = docs.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches):
        for b in batches:
            rows = [text_features(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [key, *names])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {FEATURES}")


def _share(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def default_rules() -> dict:
    """Votes 1 (good), 0 (bad) or null (abstains) from the counts; each rule looks at one trait only."""
    when, enough = F.when, F.col("n_words") >= 30
    symbols, upper = _share("n_symbols", "n_words"), _share("n_upper", "n_letters")
    letters, ended = _share("n_letters", "n_chars_seen"), _share("n_ended_lines", "n_lines")
    repeats, dups = _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    length, distinct = _share("word_chars", "n_words"), _share("n_distinct_words", "n_words")
    exclaims = _share("n_exclaims", "n_words")
    return {
        "symbols": when(symbols > 0.1, 0).when(symbols < 0.02, 1),
        "capitals": when(upper > 0.3, 0).when(upper < 0.1, 1),
        "letters": when(letters < 0.73, 0).when(letters > 0.76, 1),
        "line_ends": when(ended < 0.5, 0).when(ended >= 0.9, 1),
        "repeats": when(repeats > 0.2, 0).when(repeats < 0.1, 1),
        "line_copies": when(dups > 0.35, 0).when((dups < 0.1) & (F.col("n_lines") >= 3), 1),
        "word_length": when((length < 3) | (length > 9), 0).when((length > 4) & (length < 6.5), 1),
        "distinct": when((distinct < 0.3) & enough & (F.col("n_words") < 2000), 0).when((distinct > 0.5) & enough, 1),
        "exclaims": when(exclaims > 0.2, 0).when(exclaims < 0.05, 1),
        "size": when(F.col("n_words") < 10, 0),
    }


@dataclass
class VoteModel:
    """Two classes; where a rule votes, its vote depends on the class only. rates[rule][class][vote].

    A rule that abstains (vote 2) says nothing: short texts, which many rules can't judge, aren't worse for that.
    """

    names: list[str]
    prior: float = 0.8
    rates: np.ndarray = field(default_factory=lambda: np.empty(0))

    @classmethod
    def fit(cls, names: list[str], votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> VoteModel:
        """EM over vote patterns with their counts. votes: patterns x rules, 0, 1 or 2.

        Starts from the share of good votes in each pattern, sharpened since most rules see nothing in most bad texts,
        so class 1 stays the good one. Pseudo-counts keep rates off 0. With no rows at all the prior stays and every rule says nothing.
        """
        n = len(names)
        self = cls(names, rates=np.full((n, 2, 2), 1 / 2))
        if not len(counts):
            return self
        good, bad = (votes == 1).sum(1), (votes == 0).sum(1)
        q = np.clip(((good + 0.5) / (good + bad + 1)) ** 4, 0.02, 0.98)
        q[bad == 0] = 0.98
        one_hot = (votes[:, :, None] == np.arange(2)).astype(float)
        for _ in range(rounds):
            weight = np.stack([counts * (1 - q), counts * q])
            self.prior = float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99))
            rates = np.einsum("cp,prv->rcv", weight, one_hot) + np.array([[0.7, 0.3], [0.3, 0.7]])
            self.rates = rates / rates.sum(2, keepdims=True)
            before, q = q, self.posterior(votes)
            if np.abs(q - before).max() < 1e-9:
                break
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        s = np.log(self.prior / (1 - self.prior)) + sum(gain[votes[:, r]] for r, gain in enumerate(self._gains()))
        return 1 / (1 + np.exp(-np.clip(s, -700, 700)))

    def _gains(self) -> np.ndarray:
        """What each rule's vote (0, 1, none) adds to the log odds."""
        log = np.log(self.rates)
        return np.concatenate([log[:, 1] - log[:, 0], np.zeros((len(self.names), 1))], axis=1)

    def log_odds(self, vote_columns: dict) -> F.Column:
        """The same posterior log odds as a column expression over vote columns."""
        s = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for name, gain in zip(self.names, self._gains().tolist()):
            s = s + F.when(vote_columns[name] == 1, gain[1]).when(vote_columns[name] == 0, gain[0]).otherwise(0.0)
        return s

    def accuracies(self) -> dict[str, float]:
        """Of each rule where it votes."""
        p = np.array([1 - self.prior, self.prior])
        right = self.rates[:, 0, 0] * p[0] + self.rates[:, 1, 1] * p[1]
        return dict(zip(self.names, right.tolist()))


def score_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict | None = None, threshold: float = 0.5) -> DataFrame:
    """Weak supervision over all documents, without labels.

    Returns a row for each row of docs: key, the counts of FEATURES, a vote_<rule> column for each rule (1, 0 or
    null), p_good double, base_failed and kept. base_failed: fewer than 10 words, or over a fifth of the words in
    repeated windows of five. kept: not base_failed and p_good >= threshold.

    The EM reads how often each pattern of votes occurs over all rows: at most 3 ** rules counts reach the driver,
    however large the input. Null or empty texts have no words and fail. Rows with equal or null keys each stand for
    themselves. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rules = rules or default_rules()
    votes = {f"vote_{n}": c.cast("int") for n, c in rules.items()}
    rows = stored(with_features(docs, key, text).withColumns(votes), work_folder(spark), "votes")
    names = list(rules)
    seen = rows.groupBy(*votes).count().collect()
    table = np.array([[2 if r[f"vote_{n}"] is None else r[f"vote_{n}"] for n in names] for r in seen], int).reshape(len(seen), len(names))
    model = VoteModel.fit(names, table, np.array([r["count"] for r in seen], float))
    odds = model.log_odds({n: F.col(f"vote_{n}") for n in names})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    p = 1 / (1 + F.exp(-odds))
    return rows.withColumns({"p_good": p, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score_quality keeps. Rows that agree in key and text have one verdict."""
    row = "_row_of_text"
    marked = docs.withColumn(row, F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))))
    good = score_quality(marked, row, text, rules, threshold).filter("kept").select(row).distinct()
    return marked.join(good, row, "left_semi").drop(row)
