"""Personal data: rules, and a semi-Markov conditional random field that settles boundaries and kinds jointly.

Rules find e-mail addresses, IP addresses, card and phone numbers. A rule takes the longest match and
drops it when its check fails, so neighbours spoil each other: a phone number in front of a card
number is one match of 27 digits. The field scores whole candidate segments instead. A cluster is a
stretch of characters that such data can consist of; of its tokens (runs of digits, runs of letters,
single other characters) every segment of at most ``LONGEST`` tokens with the rough form of a kind is
a candidate. Features of the whole segment (digits, checksum, octets, shape, what stands beside it)
and of neighbouring labels add up to the score of a segmentation, and dynamic programming over the
token borders finds the best one. Text outside clusters belongs to no segment, so clusters are solved
on their own, exactly.

The field is trained on clusters drawn from all documents, labelled by the rules where no match was
dropped, and on variants of them: neighbours put side by side, national forms of phone numbers, and
spoilt ones that must not be found.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import prepare_workers

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
NONE = 4

#: Tokens of one segment at most, and groups of digits of a number that the field may find.
LONGEST, GROUPS = 40, 8
#: Clusters for training, and their tokens at most (training only).
SAMPLE, TRAINING_TOKENS = 2_000, 64
STEPS, RIDGE, RATE = 120, 1e-4, 0.15

Span = tuple[int, int, int]  # kind, start, end (exclusive), in code points

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match takes all digits of its last part, so the next one starts at the first digit of a run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[0-9 ().+-]{7,}")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+@-]*")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_NO_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in parts)


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield EMAIL, start, done
        at = text.find("@", max(done, at + 1))


def rule_spans(text: str) -> tuple[list[Span], bool]:
    """The spans the rules find, by kind, then start; and whether a match was dropped by its check."""
    spans, dropped = list(_emails(text)), False
    for kind, pattern in ((IP, _IP), (CARD, _CARD), (PHONE, _PHONE)):
        for m in pattern.finditer(text):
            if kind == IP:
                ok = octets(m[0].split("."))
            else:
                digits = _NO_DIGIT.sub("", m[0])
                ok = 16 <= len(digits) <= 19 and luhn(digits) if kind == CARD else 8 <= len(digits) <= 15
                # Most runs of digits are no card number to anyone.
                dropped |= not ok and kind == CARD and len(digits) >= 13
            dropped |= not ok and kind != CARD
            if ok:
                spans.append((kind, *m.span()))
    return spans, dropped


def clusters(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold personal data; every match of a rule lies inside one."""
    found = []
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            run = m[0].lstrip(" ).-")
            start = m.end() - len(run)
            run = run.rstrip(" ().+-")
            if len(run) >= 7:
                found.append((start, start + len(run)))
    at, covered = text.find("@"), 0
    while at >= 0:
        start = at
        while start > covered and text[start - 1] in _LOCAL:
            start -= 1
        covered = _ADDRESS.match(text, at).end()
        found.append((start, covered))
        at = text.find("@", covered)
    if len(found) < 2:
        return found
    found.sort()
    merged = [found[0]]
    for start, end in found[1:]:
        if start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


class Candidate(NamedTuple):
    first: int  # token
    last: int  # exclusive
    kind: int
    features: tuple[str, ...]


def _side(char: str) -> str:
    """Class of the character beside a segment."""
    if not char:
        return "edge"
    if char in _LOCAL and char.isalnum():
        return "digit" if char.isdigit() else "letter"
    return "blank" if char in " \t\n\r\x0b\f" else char if char < "\x80" else "letter" if char.isalpha() else "other"


def _features(kind: int, text: str, groups: list[str], left: str, right: str) -> tuple[str, ...]:
    """Features of one whole segment; ``left`` and ``right`` are the two characters on either side."""
    out = [f"left {_side(left[-1:])}", f"right {_side(right[:1])}"]
    # A digit behind one separator: the segment may be part of a longer number.
    out.append(f"left far {_side(left[:1])}" if len(left) == 2 and left[1] in " .-()" else "left near")
    out.append(f"right far {_side(right[1:2])}" if len(right) == 2 and right[0] in " .-()" else "right near")
    if kind == EMAIL:
        local, _, domain = text.partition("@")
        labels = domain.split(".")
        out += [f"labels {min(len(labels), 5)}", f"last {'alpha' if labels[-1].isalpha() else 'other'} {min(len(labels[-1]), 7)}"]
        out += [f"name {min(len(local), 3)}", f"start {_side(text[0])}", f"end {_side(text[-1])}", f"at {text.count('@')}"]
    else:
        digits = "".join(groups)
        out += [f"digits {len(digits)}", f"groups {min(len(groups), 8)}", f"start {_side(text[0])}"]
        if kind == IP:
            out += [f"octets {octets(groups)}", f"zero {any(len(g) > 1 and g[0] == '0' for g in groups)}"]
        elif kind == CARD:
            out += [f"luhn {luhn(digits)} {len(digits) >= 16}", f"even {len({len(g) for g in groups[:-1]}) < 2}", f"first {digits[0]}"]
        else:
            out += ["shape " + re.sub("[0-9]+", lambda m: str(min(len(m[0]), 9)), text), f"marks {''.join(sorted(set(_DIGIT.sub('', text))))}"]
            out.append(f"open {text.count('(') == text.count(')')}")
    return tuple(f"{KINDS[kind]} {x}" for x in out)


class Cluster:
    """The tokens of a cluster and its candidate segments; ``left`` and ``right`` stand beside it."""

    def __init__(self, text: str, left: str, right: str):
        self.tokens = _TOKEN.findall(text)
        self.borders = [0, *itertools.accumulate(map(len, self.tokens))]
        self.whole, self.before = left + text + right, len(left)

    def _made(self, kind: int, first: int, last: int, groups: list[str]) -> Candidate:
        low, high = self.borders[first] + self.before, self.borders[last] + self.before
        text = self.whole
        return Candidate(first, last, kind, _features(kind, text[low:high], groups, text[max(low - 2, 0) : low], text[high : high + 2]))

    def starting(self, i: int) -> Iterator[Candidate]:
        """The candidates whose first token is ``i``."""
        token = self.tokens[i][0]
        if token in "+(" or "0" <= token <= "9":
            yield from self._numbers(i)
        if token in _ALNUM:
            yield from self._addresses(i)

    def _numbers(self, i: int) -> Iterator[Candidate]:
        """Digits with single marks or blanks between their groups."""
        tokens = self.tokens
        number = "0" <= tokens[i][0] <= "9"
        digits, groups, gap, card = 0, [], 0, number
        for last in range(i, min(i + LONGEST, len(tokens))):
            t = tokens[last]
            if "0" <= t[0] <= "9":
                digits += len(t)
                groups.append(t)
                gap = 0
                if digits > 19 or len(groups) > GROUPS:
                    return
                if number and len(groups) == 4 and last - i == 6 and tokens[i + 1] == tokens[i + 3] == tokens[i + 5] == ".":
                    yield self._made(IP, i, last + 1, groups)
                if card and 13 <= digits:
                    yield self._made(CARD, i, last + 1, groups)
                if 7 <= digits <= 15:
                    yield self._made(PHONE, i, last + 1, groups)
            else:
                gap += 1
                if t not in (" ", "(", ")", ".", "-") and last > i or gap > 3:
                    return
                card &= gap == 1 and t in " -"

    def _addresses(self, i: int) -> Iterator[Candidate]:
        """A name, one @ and at least two labels with dots between."""
        tokens = self.tokens
        at = i + 1
        while at < len(tokens) and at - i < LONGEST // 2 and tokens[at][0] in _LOCAL:
            at += 1
        if at >= len(tokens) or tokens[at] != "@":
            return
        dots = 0
        for last in range(at + 1, min(at + LONGEST // 2, len(tokens))):
            t = tokens[last]
            if t == ".":
                if tokens[last - 1][0] not in _ALNUM and tokens[last - 1] != "-":
                    return
                dots += 1
            elif t[0] in _ALNUM:
                if dots and not (last + 1 < len(tokens) and tokens[last + 1][0] in _ALNUM):
                    yield self._made(EMAIL, i, last + 1, [])
            elif t != "-":
                return


def candidates(text: str, left: str, right: str) -> tuple[list[int], list[Candidate]]:
    """Token borders of a cluster and all its candidate segments, by end."""
    cluster = Cluster(text, left, right)
    found = [c for i in range(len(cluster.tokens)) for c in cluster.starting(i)]
    return cluster.borders, sorted(found, key=lambda c: (c.last, c.first, c.kind))


class Field(NamedTuple):
    """Weights of segment features, and scores of a label after a label (rows: before; ``NONE`` outside)."""

    weights: dict[str, float]
    moves: list[list[float]]


#: A field without training finds nothing beyond the rules.
EMPTY = Field({}, [[0.0] * 5 for _ in range(5)])


def best_segments(cluster: Cluster, field: Field) -> list[Span]:
    """The segments (kind, first token, last exclusive) of the best segmentation.

    Candidates are made, scored and let go where they start; what stays is a score and a pointer per
    label and token border.
    """
    weights, moves = field.weights, field.moves
    worst, n = float("-inf"), len(cluster.tokens)
    best = [[worst] * 5 for _ in range(n + 1)]
    back: list[list] = [[None] * 5 for _ in range(n + 1)]
    best[0][NONE] = 0.0
    for i in range(n):
        here = best[i]
        entering = [max((here[y] + moves[y][kind], y) for y in range(5)) for kind in range(5)]
        if entering[NONE][0] > best[i + 1][NONE]:
            best[i + 1][NONE], back[i + 1][NONE] = entering[NONE][0], (i, entering[NONE][1])
        for c in cluster.starting(i):
            score = entering[c.kind][0] + sum([weights.get(f, 0.0) for f in c.features])
            if score > best[c.last][c.kind]:
                best[c.last][c.kind], back[c.last][c.kind] = score, (i, entering[c.kind][1])
    y = max((best[n][y] + moves[y][NONE], y) for y in range(5))[1]
    out, j = [], n
    while j:
        first, label = back[j][y]
        if y != NONE:
            out.append((y, first, j))
        j, y = first, label
    return out[::-1]


def field_spans(text: str, left: str, right: str, field: Field) -> list[Span]:
    """What the field finds in a cluster."""
    cluster = Cluster(text, left, right)
    return [(kind, cluster.borders[first], cluster.borders[last]) for kind, first, last in best_segments(cluster, field)]


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that ``spans`` cover."""
    starts, ends = [], []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and these with what the field adds where no rule's span lies; both by kind, then start."""
    ruled, added = [], []
    for start, end in clusters(text):
        cluster = text[start:end]
        mine, _ = rule_spans(cluster)
        ruled += [(k, start + a, start + b) for k, a, b in mine]
        if not field.weights:
            continue
        starts, ends = _merged(mine)
        for kind, a, b in field_spans(cluster, text[max(start - 2, 0) : start], text[end : end + 2], field):
            # The first stretch that ends behind the span's begin must begin behind its end.
            at = bisect.bisect_right(ends, a)
            if at == len(starts) or starts[at] >= b:
                added.append((kind, start + a, start + b))
    ruled.sort()
    return ruled, sorted(ruled + added) if added else ruled


class Example(NamedTuple):
    text: str
    left: str
    right: str
    spans: tuple[Span, ...]


#: Numbers that are no personal data, for training: dates, times, amounts, versions, article and serial numbers (# is a digit).
_OTHER_NUMBERS = (
    "####-##-##", "####-##-## ##", "##.##.####", "##-##-####", "####-####", "#.##############", "####.##", "###.###.###", "#######", "##########", "#############",
    "##############", "###############", "################", "###-#-##-######-#", "#### #### ####", "#### #### #### ####", "### ### ###", "#.#.## (####)", "####-##-##-####",
    "## ## ## ##", "(####) ####", "#####-####", "####.####.####", "########-####-####",
)


def _luhn_fixed(value: str) -> str:
    """``value`` with its last digit changed so that the checksum holds."""
    head, last = value[:-1], value[-1]
    digits = _NO_DIGIT.sub("", head)
    return head + next((d for d in "0123456789" if luhn(digits + d)), last)


def _spoilt(kind: int, value: str, rng: random.Random) -> str:
    """``value`` changed so that it is none of its kind."""
    if kind == CARD:
        at = rng.choice([m.start() for m in _DIGIT.finditer(value)])
        changed = value[:at] + str((int(value[at]) + rng.randint(1, 9)) % 10) + value[at + 1 :]
        return rng.choice([changed, _luhn_fixed(value[: rng.choice([13, 14, 15])])])
    if kind == IP:
        parts = value.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return ".".join(parts)
    if kind == PHONE:
        digits = _NO_DIGIT.sub("", value)
        return rng.choice([digits, digits[:10], digits[:7], digits[:8], f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", f"{digits[:4]}.{digits[4:8]}"])
    return value.replace(".", "-")


def _national(value: str) -> str | None:
    """A phone number without its country code, where it is written in groups of three, three and four."""
    m = re.fullmatch(r"\+[0-9]{1,3}[ .-]?(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})", value)
    return m and m[1]


_BEFORE, _AFTER = ("n ", "n ", ": ", "\n", "", '"', ", "), (" t", " t", ". ", "\n", "", '"', ", ", "%%")


def _row(rng: random.Random, *parts: tuple[int | None, str]) -> Example:
    """Values side by side; those with a kind are spans of it."""
    text, spans = "", []
    for kind, value in parts:
        text += rng.choice([" ", " ", " ", ", ", "  ", " - "]) if text else ""
        if kind is not None:
            spans.append((kind, len(text), len(text) + len(value)))
        text += value
    return Example(text, rng.choice(_BEFORE), rng.choice(_AFTER), tuple(spans))


def examples(found: list[tuple[str, str, str]], seed: int = 11) -> list[Example]:
    """Labelled clusters: those without a dropped match as the rules see them, and variants.

    A variant is read as one cluster even where it has a character that ends one.
    """
    rng = random.Random(seed)
    out, pool = [], []
    for text, left, right in found:
        spans, dropped = rule_spans(text)
        spans.sort(key=lambda s: s[1:])
        if dropped or any(a[2] > b[1] for a, b in zip(spans, spans[1:])):
            continue
        out.append(Example(text, left, right, tuple(spans)))
        pool += [(k, text[a:b]) for k, a, b in spans]
    for kind, value in pool:
        other = rng.choice(pool)
        out.append(_row(rng, (kind, value), other))
        out.append(_row(rng, (kind, value), (kind, value), other))
        number = re.sub("#", lambda _: str(rng.randrange(10)), rng.choice(_OTHER_NUMBERS))
        number = _luhn_fixed(number) if rng.random() < 0.5 else number
        if len(_NO_DIGIT.sub("", number)) >= 16 and luhn(_NO_DIGIT.sub("", number)):
            number = number[:-2]
        bad = _spoilt(kind, value, rng)
        if kind == CARD and len(_NO_DIGIT.sub("", bad)) >= 16 and luhn(_NO_DIGIT.sub("", bad)):
            bad = number
        out += [_row(rng, (None, number)), _row(rng, (None, bad))]
        out.append(rng.choice([_row(rng, (None, bad), other), _row(rng, other, (None, bad)), _row(rng, (None, number), other), _row(rng, other, (None, number))]))
        if kind != EMAIL:
            # Digits inside a word or a longer code.
            out.append(Example(rng.choice([value, bad, _luhn_fixed(number)]), rng.choice(["=a", "3f", "xY"]), rng.choice(["d8", "b ", "Z2"]), ()))
        short = _national(value) if kind == PHONE else None
        if short:
            out += [_row(rng, (PHONE, short)), _row(rng, (PHONE, short), other)]
    return out


def fit(labelled: list[Example]) -> Field:
    """Weights that maximise the conditional likelihood of the segmentations less a ridge, by Adam on exact gradients.

    Equal examples count together; all go through the recursions side by side, position by position.
    Examples whose spans are no candidates or that are longer than ``TRAINING_TOKENS`` are left out.
    """
    numbers: dict[str, int] = {}
    seen: Counter = Counter()
    for e in labelled:
        borders, found = candidates(e.text, e.left, e.right)
        wanted = set(e.spans)
        marks = tuple((c.kind, borders[c.first], borders[c.last]) in wanted for c in found)
        if len(borders) - 1 <= TRAINING_TOKENS and sum(marks) == len(wanted) and found:
            seen[(len(borders) - 1, tuple(found), marks)] += 1
    if not any(any(marks) for _, _, marks in seen):
        return EMPTY
    sizes, counts, ends = [], [], []
    owner, first, last, kind, gold, rows, columns = [], [], [], [], [], [], []
    for (size, found, marks), count in seen.items():
        for c, mark in zip(found, marks, strict=True):
            columns += [numbers.setdefault(f, len(numbers)) for f in c.features]
            rows += [len(owner)] * len(c.features)
            owner.append(len(sizes))
            first.append(c.first)
            last.append(c.last)
            kind.append(c.kind)
            gold.append(mark)
        sizes.append(size)
        counts.append(count)
        ends.append(size)
    owner, first, last, kind, rows, columns = (np.array(x) for x in (owner, first, last, kind, rows, columns))
    sizes, counts, gold = np.array(sizes), np.array(counts, dtype=float), np.array(gold)
    n, longest, total = len(sizes), int(sizes.max()), float(np.sum(counts))
    by_end = [np.flatnonzero(last == j) for j in range(longest + 1)]
    by_start = [np.flatnonzero(first == j) for j in range(longest + 1)]
    weight = counts[owner]
    observed = np.bincount(columns, weights=(weight * gold)[rows], minlength=len(numbers))
    # Labels before and after every place of the gold segmentations.
    moved = np.zeros((5, 5))
    for i in range(n):
        mine = np.flatnonzero((owner == i) & gold)
        label, at = NONE, 0
        for c in [*sorted(mine.tolist(), key=lambda c: first[c]), None]:
            stop = int(sizes[i]) if c is None else int(first[c])
            for _ in range(at, stop):
                moved[label, NONE] += counts[i]
                label = NONE
            if c is not None:
                moved[label, kind[c]] += counts[i]
                label, at = int(kind[c]), int(last[c])
        moved[label, NONE] += counts[i]
    inside = np.arange(longest + 1) <= sizes[:, None]
    low = -1e30

    def total_of(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    state = np.zeros(len(numbers) + 25)
    mean, square = np.zeros_like(state), np.zeros_like(state)
    everyone = np.arange(n)
    for step in range(1, STEPS + 1):
        w, moves = state[:-25], state[-25:].reshape(5, 5)
        score = np.bincount(rows, weights=w[columns], minlength=len(owner))
        forward = np.full((n, longest + 1, 5), low)
        forward[:, 0, NONE] = 0.0
        entered = np.zeros(len(owner))
        for j in range(1, longest + 1):
            forward[:, j, NONE] = total_of(forward[:, j - 1] + moves[:, NONE], 1)
            c = by_end[j]
            if len(c):
                entered[c] = total_of(forward[owner[c], first[c]] + moves[:, kind[c]].T, 1) + score[c]
                np.logaddexp.at(forward[:, j], (owner[c], kind[c]), entered[c])
        backward = np.full((n, longest + 1, 5), low)
        backward[everyone, sizes] = moves[:, NONE]
        for j in range(longest - 1, -1, -1):
            open_ = j < sizes
            ahead = np.where(open_, backward[:, j + 1, NONE], low)
            np.logaddexp(backward[:, j], moves[:, NONE] + ahead[:, None], out=backward[:, j])
            c = by_start[j]
            if len(c):
                onward = moves[:, kind[c]].T + (score[c] + backward[owner[c], last[c], kind[c]])[:, None]
                np.logaddexp.at(backward[:, j], owner[c], onward)
        partition = total_of(forward[everyone, sizes] + moves[:, NONE], 1)
        chance = np.exp(np.minimum(entered + backward[owner, last, kind] - partition[owner], 0))
        expected = np.bincount(columns, weights=(weight * chance)[rows], minlength=len(numbers))
        went = np.zeros((5, 5))
        outside = forward[:, :-1] + moves[:, NONE] + (np.where(inside[:, 1:], backward[:, 1:, NONE], low) - partition[:, None])[:, :, None]
        went[:, NONE] += (np.exp(np.minimum(outside, 0)) * counts[:, None, None]).sum(axis=(0, 1))
        closing = forward[everyone, sizes] + moves[:, NONE] - partition[:, None]
        went[:, NONE] += (np.exp(np.minimum(closing, 0)) * counts[:, None]).sum(axis=0)
        before = forward[owner, first] + moves[:, kind].T + (score + backward[owner, last, kind] - partition[owner])[:, None]
        np.add.at(went.T, kind, np.exp(np.minimum(before, 0)) * weight[:, None])
        gradient = np.concatenate([expected - observed, (went - moved).ravel()]) / total + RIDGE * state
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        state = state - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Field({f: float(state[i]) for f, i in numbers.items()}, state[-25:].reshape(5, 5).tolist())


#: What is read of the documents.
_COLUMNS = ("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")


def _found_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            for start, end in clusters(text or ""):
                if end - start <= 4 * TRAINING_TOKENS:
                    rows.append((text[start:end], text[max(start - 2, 0) : start], text[end : end + 2]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["cluster", "before", "after"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` different clusters of all documents, in the order of a hash.

    Only clusters of at most four times ``TRAINING_TOKENS`` characters are drawn; they alone reach
    the driver. Where none holds personal data by the rules, the result is ``EMPTY``.
    """
    prepare_workers(docs.sparkSession)
    found = docs.selectExpr(*_COLUMNS).mapInArrow(_found_clusters, "cluster string, before string, after string")
    drawn = found.distinct().orderBy(F.xxhash64("cluster", "before", "after"), "cluster", "before", "after").limit(sample)
    return fit(examples([tuple(r) for r in drawn.collect()]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base (what the rules find) and spans (these and what the field adds) of every document.

    Spans are in code points, end exclusive, by kind, then start. Spans of the field overlap no other;
    the rules' spans of different kinds may overlap each other, and all stay. ``docs`` has doc_id and
    text; other columns are ignored. Null and empty texts have no spans; repeated rows get equal
    results, null doc_ids stay; an empty table gives an empty table. Time and memory grow with a
    text's length, whatever it holds: a segment has at most ``LONGEST`` tokens.
    """
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t.as_py() or "", field) for t in batch.column("text")]
            listed = [
                pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans[i]] for spans in found], pa.list_(_SPAN)) for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *listed], names=["doc_id", "base", "spans"])

    return docs.selectExpr(*_COLUMNS).mapInArrow(run, SCHEMA)


def masked_text(text: str, spans: list[Span]) -> str:
    """``text`` with every span, or stretch of overlapping spans, replaced by the name of its first kind."""
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= done:
            parts += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def masked(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, text) with personal data replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``; null stays null."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked_text(t, all_spans(t, field)[1]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.selectExpr(*_COLUMNS).mapInArrow(run, "doc_id long, text string")
