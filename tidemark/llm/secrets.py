"""Secrets in texts: base patterns, and guess costs of values in credential context.

The base finds three kinds of spans by pattern (see BASE). The method looks
at values that a wider set of credential words introduces and estimates how
many guesses each would take: a dynamic program finds the cheapest way to
write the value as dictionary words, dates, repeats, keyboard walks and
single brute-forced characters. A value of at least `strong` decades outside
the base spans becomes a span of kind `guess`.

Null text is empty and has no spans; an empty table gives no rows; repeated
rows give repeated results. Texts are searched whole, values of any length.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready, text_of
from .encoders import default_ranks, encoder

#: Fixed by the contract: kind, pattern, the group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: The same spans as `hex` without a match for each short run.
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
CONTEXT = re.compile(
    r"""(?ai)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|secret|client)[_-]?(?:key|secret|token)|login)\b["']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20+is\x20+|(?<=bearer)\x20+)(?:bearer\x20+)?["'`]?([^\s"'`,;<>]{6,})"""
)
#: Whatever matches BASE's assign or CONTEXT holds one of these in lower case.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "_key", "-key", "apikey", "accesskey", "privatekey", "clientkey", "login")
STRONG = 8.0
#: Frequent passwords that no list of prose words holds.
COMMON = "password passwd admin letmein welcome qwerty abc iloveyou dragon monkey master login princess sunshine shadow football baseball trustno secret test guest root user changeme default".split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4301$5@7", "aeoissat")
DATE = re.compile(r"(?a)(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
DATE_COST = {4: math.log10(120)}
#: A longer keyboard walk is written as several, so that the work stays in proportion to the value.
LONGEST_WORD, LONGEST_WALK, LONGEST_PERIOD = 24, 64, 16
_words: dict[str, dict[str, float]] = {}


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            for dy, dx in ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0)):
                if 0 <= y + dy < len(ROWS) and 0 <= x + dx < len(ROWS[y + dy]):
                    near.setdefault(key, set()).add(ROWS[y + dy][x + dx])
    return {k: "".join(sorted(v)) for k, v in near.items()}


NEAR = _neighbours()


def words(path: str) -> dict[str, float]:
    """Decades of guesses for each word: its rank among the vocabulary's words."""
    if path not in _words:
        ranked, seen = list(COMMON), set(COMMON)
        for token in encoder(path)[2]:
            word = token.decode("utf-8", "ignore").strip().lower()
            if len(word) >= 3 and word.isalpha() and word not in seen:
                seen.add(word)
                ranked.append(word)
        _words[path] = {w: math.log10(k + 2) for k, w in enumerate(ranked)}
    return _words[path]


def single(c: str) -> float:
    """Decades of guesses for one brute-forced character."""
    if c.isdigit():
        return 1.0
    if c.isalpha() and c.isascii():
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


def guess_cost(value: str, ranks: dict[str, float]) -> float:
    """log10 of the guesses of the cheapest segmentation."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for m in (DATE.match(value, i) for i in range(n)):
        if m:
            dates.setdefault(m.start(), []).append(m.end())
    # run[p][i]: how far value[i:] keeps repeating with period p
    code = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    runs = []
    for p in range(1, min(LONGEST_PERIOD, n // 2) + 1):
        differs = np.append(np.flatnonzero(code[p:] != code[:-p]), n - p)
        runs.append(differs[np.searchsorted(differs, np.arange(n - p + 1))] + p)
    begun: dict[tuple[int, int], float] = {}
    for i in range(n):
        at = best[i]

        def reach(j: int, cost: float, at: float = at) -> None:
            if at + cost < best[j]:
                best[j] = at + cost

        reach(i + 1, single(value[i]))
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            for shape, extra in ((low, 0.0), (plain, 0.6)):
                if (rank := ranks.get(shape[i:j])) is not None:
                    part = value[i:j]
                    mixed = 0.0 if part == low[i:j] else 0.3 if part[1:] == low[i + 1 : j] or part.isupper() else 0.3 * sum(map(str.isupper, part))
                    reach(j, rank + extra + mixed + 0.3)
        for j in dates.get(i, ()):
            reach(j, DATE_COST.get(j - i, math.log10(365 * 120 * 4)))
        j, turns, last = i + 1, 0, ""
        while j < min(n, i + LONGEST_WALK) and low[j] in NEAR.get(low[j - 1], ""):
            step = f"{ord(low[j]) - ord(low[j - 1])}"
            turns, last, j = turns + (step != last), step, j + 1
            if j - i >= 3:
                reach(j, math.log10(47) + 0.5 * turns + math.log10(j - i))
        for p, run in enumerate(runs, 1):
            if i + p > n - p:
                break
            times = (int(run[i]) - i) // p
            if times >= 2 and (p, i - p) not in begun:
                begun[p, i] = 0.0
                unit = value[i : i + p]
                cost = min(sum(map(single, unit)), ranks.get(unit.lower(), math.inf)) + math.log10(times)
                reach(i + p * times, cost)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found, low = [], text.lower()
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(w in low for w in ASSIGN_HINTS):  # far cheaper than the pattern
            continue
        for m in (HEX_RUN if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def guess_spans(text: str, base: list[tuple[int, int, str]], ranks: dict[str, float], strong: float) -> list[tuple[int, int, str, float]]:
    """Strong values in credential context that no base span overlaps."""
    out, low = [], text.lower()
    if not any(w in low for w in CONTEXT_HINTS):
        return out
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        if any(s < end and start < e for s, e, _ in base):
            continue
        cost = guess_cost(m[1], ranks)
        if cost >= strong:
            out.append((start, end, "guess", cost))
    return out


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


COLUMNS = {
    "doc_id": pa.int64(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(),
    "n_guess": pa.int64(), "strongest": pa.float64(), "found": pa.list_(pa.string()),
}


def find_secrets(docs: DataFrame, strong: float = STRONG, ranks_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, spans, the decades of its strongest value, the texts found."""
    ready(docs.sparkSession)
    path = ranks_path or default_ranks()

    def scan(batches):
        ranks = words(path)
        for batch in batches:
            out = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_spans(body)
                more = guess_spans(body, base, ranks, strong)
                spans = sorted([*base, *(x[:3] for x in more)], key=lambda s: (s[0], KINDS.index(s[2])))
                values = [m[2] for m in BASE[0][1].finditer(body) if len(m[2]) >= 6] if base else []
                costs = [guess_cost(v, ranks) for v in values] + [x[3] for x in more]
                n = {k: sum(s[2] == k for s in spans) for k in KINDS}
                out.append((key, n["assign"], n["access"], n["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), n["guess"], max(costs, default=None), [body[s:e] for s, e, _ in spans]))
            columns = list(zip(*out)) or [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COLUMNS.values())], names=list(COLUMNS))

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, strongest double, found array<string>")
