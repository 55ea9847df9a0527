"""License detection by ordered signature rules.

A text becomes its words (A-Z lower-cased; runs of digits, letters and all
characters beyond ASCII) with one space between. A rule is a hand-written regex
over these words with a label and a priority (``license_rules``). Its keywords are
read off the regex: strings of which every match holds one. One pass of an
Aho-Corasick automaton finds which occur, so a rule's regex runs only on texts
that may match it, and none that does is passed over. Detections are taken in the order of priority, then length, then
start; one whose interval lies inside that of a detection taken before is
suppressed. Base phrases are rules of the highest priority that nothing
suppresses, and every place of theirs counts.

Defined cases: null text is empty text (no words, no labels, score 0); repeated
rows are scanned one by one; a very long text is scanned whole, with memory in
proportion to it; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import AMBIGUOUS, BASE, GROUPS, SPDX

@dataclass(eq=False)
class Rule:
    label: str
    priority: int
    weight: float
    pattern: str
    base: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        if self.base:
            return re.compile(f"(?= {self.pattern} )")  # places may overlap
        body = self.pattern.removeprefix("^").removesuffix("$")
        return re.compile("^" * self.pattern.startswith("^") + f" {body}(?= " + "$" * self.pattern.endswith("$") + ")")

    @cached_property
    def keywords(self) -> frozenset[str]:
        """Strings of which every match holds one."""
        return frozenset([self.pattern]) if self.base else held(self.pattern.strip("^$"))


TOKEN = re.compile(r"\(\?:|\||\)\??|[a-z0-9 ]\??")


def parsed(pattern: str) -> list[tuple]:
    """A regex as a list of (alternatives, whether they may be absent); an
    alternative is such a list, and a literal has itself as the only one."""
    tokens = TOKEN.findall(pattern)
    if "".join(tokens) != pattern:
        raise ValueError(f"not a signature: {pattern}")

    def read(at: int) -> tuple[list[list[tuple]], int]:
        branches: list[list[tuple]] = [[]]
        while at < len(tokens):
            t = tokens[at]
            if t == "(?:":
                inner, at = read(at + 1)
                branches[-1].append((inner, tokens[at].endswith("?")))
            elif t == "|":
                branches.append([])
            elif t[0] == ")":
                return branches, at
            else:
                branches[-1].append((t[0], t.endswith("?")))
            at += 1
        return branches, at

    branches, _ = read(0)
    return branches[0] if len(branches) == 1 else [(branches, False)]


def held(pattern: str | list[tuple]) -> frozenset[str]:
    """Strings of which every match holds one: the run of literals, or the group,
    whose shortest string is longest."""
    choices: list[frozenset[str]] = []
    run = ""
    for item, optional in [*(parsed(pattern) if isinstance(pattern, str) else pattern), ("", True)]:
        if isinstance(item, str) and not optional:
            run += item
            continue
        choices.append(frozenset([run]))
        run = ""
        if not isinstance(item, str) and not optional:
            choices.append(frozenset().union(*map(held, item)))
    return max(choices, key=lambda c: (min(map(len, c)), -len(c)))


def rules() -> list[Rule]:
    """All rules, base phrases first, then by priority."""
    out = [Rule(label, 9, 1.0, phrase, True) for phrase, label in BASE.items()]
    for group, priority, weight in GROUPS:
        out += [Rule(label, priority, weight, pattern) for label, pattern in group]
    for name, label in SPDX.items():
        out += [Rule(label, 5, 0.95, f"spdx license identifier {name}"), Rule(label, 4, 0.9, f"licen(?:s|c)e {name}"), Rule(label, 3, 0.8, f"^{name}$" if name in AMBIGUOUS else name)]
    return sorted(out, key=lambda r: -r.priority)


WORD = np.ones(256, bool)
for a, b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    WORD[a : b + 1] = False
# A-Z are words once lower-cased
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def normalise(text: str) -> tuple[str, int]:
    """Words with one space around each, and their number."""
    data = FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    inside = np.concatenate(([False], WORD[data]))
    data = np.concatenate(([32], data)).astype(np.uint8)
    data[~inside] = 32
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[0] = True
    n = int((inside[1:] & ~inside[:-1]).sum())
    out = data[keep].tobytes().decode("utf-8", "replace")
    return (out if out.endswith(" ") else out + " ") if n else "", n


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drops detections inside others of a higher priority, or of the same one
    and at least as long. Base phrases always stay."""
    taken: list[tuple[int, int, Rule]] = []
    for priority in sorted({r.priority for _, _, r in found}, reverse=True):
        taken.sort(key=lambda x: x[:2])
        starts = [x[0] for x in taken]
        ends = list(accumulate((x[1] for x in taken), max))
        furthest = -1
        for a, b, rule in sorted((x for x in found if x[2].priority == priority), key=lambda x: (x[0], -x[1])):
            over = bisect_right(starts, a)
            if rule.base or b > furthest and not (over and ends[over - 1] >= b):
                taken.append((a, b, rule))
                furthest = max(furthest, b)
    return taken


class Scanner:
    def __init__(self, ordered: list[Rule] | None = None):
        self.rules = rules() if ordered is None else ordered
        self.keys = ahocorasick.Automaton()
        by_key: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            for key in rule.keywords:
                by_key.setdefault(key, []).append(k)
        for key, ids in by_key.items():
            self.keys.add_word(key, ids)
        self.keys.make_automaton()

    def gated(self, words: str) -> list[int]:
        """The rules that can match, in order."""
        return sorted({k for _, ids in self.keys.iter(words) for k in ids})

    def scan(self, text: str) -> dict:
        words, n = normalise(text)
        found, places, base = [], [], set()
        spaces: list[int] = []
        for k in self.gated(words) if n else []:
            rule = self.rules[k]
            for m in rule.regex.finditer(words):
                if rule.base:
                    spaces = spaces or [i for i, c in enumerate(words) if c == " "]
                    places.append(bisect_right(spaces, m.start()) - 1)
                    base.add(rule.label)
                    found.append((m.start(), m.start() + len(rule.pattern) + 1, rule))
                else:
                    found.append((m.start(), m.end(), rule))
        taken = resolve(found)
        miss = 1.0
        for label in {r.label for _, _, r in taken}:
            miss *= 1 - max(r.weight for _, _, r in taken if r.label == label)
        return {
            "n_words": n,
            "n_base": len(places),
            "first_word": min(places) if places else None,
            "last_word": max(places) if places else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted({r.label for _, _, r in taken})),
            "score": 1 - miss,
            "n_detections": len(taken),
        }


_scanner: list[Scanner] = []
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64())])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: what the rules find in its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        for batch in batches:
            rows = [{"doc_id": i} | _scanner[0].scan(text or "") for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long")
