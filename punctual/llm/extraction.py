"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is its sequence of leaf blocks; each is main text or not. The field has weights for features
of a block (ancestor tags and names, length, links, punctuation, place) and for the change from one
block's label to the next one's. It is trained on pages whose markup names the article, and on
variants of them in which other tags, names or none stand for the same parts and menus, notices,
forms or reader comments are put in; pages are decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .blocks import Block, leaf_blocks
from .storage import prepare_workers

#: Labelled pages that the field is fitted on, variants of each, and blocks of a training sequence.
SAMPLE, VARIANTS, SEQUENCE = 400, 3, 48
RIDGE, STEPS = 2e-3, 200
_FLAGS = 14
_LENGTHS = (2, 5, 10, 20, 40, 80)
N_FEATURES = _FLAGS + 4 + len(_LENGTHS) + 1 + 3 + 5 + 3


def block_features(found: list[Block]) -> list[list[int]]:
    """Numbers of the features that hold, block by block."""
    out = []
    n = len(found)
    for i, (text, flags, link_share, tag) in enumerate(found):
        f = [k for k in range(_FLAGS) if flags >> k & 1]
        base = _FLAGS
        inside, against = flags & (B.ARTICLE | B.POSITIVE), flags & (B.BOILER | B.NEGATIVE | B.COMMENTS)
        f.append(base + (0 if inside and against else 1 if inside else 2 if against else 3))
        base += 4
        words = text.count(" ") + 1
        f.append(base + sum(words > limit for limit in _LENGTHS))
        base += len(_LENGTHS) + 1
        f.append(base + (0 if link_share < 0.2 else 1 if link_share < 0.7 else 2))
        base += 3
        if text[-1] in ".!?:;\"'”’»…。":
            f.append(base)
        if "©" in text or "cookie" in text.lower():
            f.append(base + 1)
        if text.isupper():
            f.append(base + 2)
        if tag in ("li", "td", "th", "dt", "dd", "option", "button"):
            f.append(base + 3)
        if tag in ("div", "section", "body", "span", ""):
            f.append(base + 4)
        base += 5
        if i == 0:
            f.append(base)
        if i == n - 1:
            f.append(base + 1)
        f.append(base + 2)
        out.append(f)
    return out


class Field(NamedTuple):
    """``weights`` of label 1 against label 0, and (2, 2) scores of a label after a label."""

    weights: np.ndarray
    moves: np.ndarray


def rule_field() -> Field:
    """What stands in where no page names its article: names and tags decide, then length and links."""
    w = np.zeros(N_FEATURES)
    w[[0, 2]] = 3.0
    w[[1, 3, 4, 10, 11, 12, 13]] = -3.0
    lengths = _FLAGS + 4
    w[lengths : lengths + len(_LENGTHS) + 1] = (-2, -1.5, -1, 0, 0.5, 1, 1.5)
    w[lengths + len(_LENGTHS) + 3] = -3.0
    return Field(w, np.array([[0.5, -0.5], [-0.5, 0.5]]))


def viterbi(scores: list[float], moves: np.ndarray) -> list[int]:
    """Best labels of a sequence of scores of label 1 (label 0 scores nothing)."""
    (m00, m01), (m10, m11) = moves.tolist()
    off = on = None
    back = []
    for s in scores:
        if off is None:
            off, on = 0.0, s
            back.append((0, 1))
            continue
        stay_off, from_on = off + m00, on + m10
        to_on, stay_on = off + m01, on + m11
        back.append((int(from_on > stay_off), int(stay_on >= to_on)))
        off, on = max(stay_off, from_on), max(to_on, stay_on) + s
    labels, state = [], int(on is not None and on > off)
    for pointers in reversed(back):
        labels.append(state)
        state = pointers[state]
    return labels[::-1]


def main_blocks(page: str, field: Field) -> list[str]:
    found = leaf_blocks(page)
    weights = field.weights.tolist()
    labels = viterbi([sum(weights[k] for k in f) for f in block_features(found)], field.moves)
    return [b.text for b, label in zip(found, labels, strict=True) if label]


_ARTICLE_AS = (
    "<article>|</article>", "<article class='post'>|</article>", "<main>|</main>", "<main><article>|</article></main>", "<div class='post-content'>|</div>",
    "<div id='content'>|</div>", "<section class='entry'>|</section>", "<div>|</div>", "<div class='story'>|</div>", "<div itemprop='articleBody'>|</div>",
)
_ASIDES = (
    "<aside>{}</aside>", "<div class='sidebar'><p>{}</p></div>", "<div class='cookie-notice'><p>{}</p></div>", "<div class='ad'>{}</div>", "<header>{}</header>",
    "<div class='notice'>{}</div>", "<form><label>{}</label><button>OK</button></form>", "<section class='related'><ul><li><a href='#'>{}</a></li></ul></section>",
    "<div id='newsletter'><p>{}</p></div>", "<nav><a href='#'>{}</a></nav>", "<footer><p>{}</p></footer>", "<ul class='menu'><li><a href='#'>{}</a></li></ul>",
    "<div class='share'>{}</div>", "<div role='dialog' class='consent'><p>{}</p><button>OK</button></div>", "<aside class='promo'><h3>{}</h3><p>{}</p></aside>",
)
_COMMENTS_AS = (
    "<section id='comments'><h2>Comments</h2>{}</section>", "<div class='comments'>{}</div>", "<ol class='commentlist'>{}</ol>", "<section class='comments'>{}</section>",
)
_COMMENT_AS = ("<div class='comment'><p>{}</p></div>", "<li><p>{}</p></li>", "<article class='comment'><p>{}</p></article>", "<p>{}</p>")
_ARTICLE = re.compile(r"<article\b[^>]*>(.*?)(</article\s*>|(?=<footer\b)|\Z)", re.S | re.I)
_MARK = "\ue123"


def variants(page: str, seed: int) -> Iterator[tuple[list[Block], list[int]]]:
    """The page and its variants as (blocks, labels): label 1 inside the named article and outside what was put in."""
    found = _ARTICLE.search(page)
    if not found:
        return
    rng = random.Random(seed)
    inner = found[1]
    # A private-use character marks the article's own text through all changes.
    marked = re.sub(r"(^|>)([^<]*[^<\s][^<]*)", lambda m: f"{m[1]}{_MARK}{m[2]}", re.sub(r"<(script|style)\b.*?</\1\s*>", "", inner, flags=re.S | re.I))
    outside = [b.text for b in leaf_blocks(page[: found.start()] + page[found.end() :])] or ["Home"]
    own = [b.text for b in leaf_blocks(inner)] or ["Text"]
    for number in range(1 + VARIANTS):
        before, after, body = page[: found.start()], page[found.end() :], marked
        if number == 0:
            whole = before + "<article>" + body + "</article>" + after
        else:
            opened, closed = rng.choice(_ARTICLE_AS).split("|")
            extra = lambda: rng.choice(_ASIDES).replace("{}", rng.choice(outside)[:400])
            cuts = [m.end() for m in re.finditer(r"</p\s*>", body, re.I)]
            for _ in range(rng.randint(0, 2)):
                if cuts:
                    cut = rng.choice(cuts)
                    body = body[:cut] + extra() + body[cut:]
                    cuts = [m.end() for m in re.finditer(r"</p\s*>", body, re.I)]
            if rng.random() < 0.5:
                each = rng.choice(_COMMENT_AS)
                comments = rng.choice(_COMMENTS_AS).format("".join(each.format(rng.choice(own)[: rng.choice((60, 300, 900))]) for _ in range(rng.randint(1, 5))))
                if rng.random() < 0.4:
                    body += comments
                else:
                    after = comments + after
            whole = before + "".join(extra() for _ in range(rng.randint(0, 3))) + opened + body + closed + "".join(extra() for _ in range(rng.randint(0, 2))) + after
        # The article's texts that were copied into comments carry no mark.
        seen = leaf_blocks(whole)
        yield [b._replace(text=b.text.replace(_MARK, "").strip() or " ") for b in seen], [int(_MARK in b.text) for b in seen]


def fit(sequences: list[list[list[int]]], labels: list[list[int]]) -> Field:
    """Weights that maximise the conditional likelihood less a ridge, by Adam on exact gradients.

    All sequences go through the forward and backward recursions side by side, padded at the end.
    """
    n, longest = len(sequences), max(map(len, sequences))
    length = np.array([len(s) for s in sequences])
    x = np.zeros((n, longest, N_FEATURES), dtype=np.float32)
    y = np.zeros((n, longest), dtype=np.int64)
    for i, (s, t) in enumerate(zip(sequences, labels, strict=True)):
        for j, f in enumerate(s):
            x[i, j, f] = 1
        y[i, : len(t)] = t
    mask = np.arange(longest) < length[:, None]
    observed = np.einsum("ntf,nt->f", x, y.astype(np.float32))
    pairs = mask[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    state = np.zeros(N_FEATURES + 4)
    mean, square = np.zeros_like(state), np.zeros_like(state)
    total = mask.sum()
    for step in range(1, STEPS + 1):
        weights, moves = state[:N_FEATURES], state[N_FEATURES:].reshape(2, 2)
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = x @ weights.astype(np.float32)
        forward = np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1]) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        partition = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(moves[:, 0] + ahead[:, 0, None], moves[:, 1] + ahead[:, 1, None])
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        on = np.exp(forward[:, :, 1] + backward[:, :, 1] - partition[:, None]) * mask
        expected = np.einsum("ntf,nt->f", x, on.astype(np.float32))
        joint = forward[:, :-1, :, None] + moves + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - partition[:, None, None, None]
        moved = (np.exp(np.minimum(joint, 0)) * pairs[:, :, None, None]).sum(axis=(0, 1))
        gradient = np.concatenate([(expected - observed) / total, ((moved - seen) / total).ravel()]) + RIDGE * state / 10
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        state = state - 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Field(state[:N_FEATURES], state[N_FEATURES:].reshape(2, 2))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled training sequences of each page: numbers of the features of each block, and labels."""
    for batch in batches:
        ids, rows, labels = [], [], []
        for page_id, page in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
            for found, label in variants(page, page_id):
                if found:
                    # Windows around the article's borders; training alone is bounded, decoding never.
                    features = block_features(found)
                    first = label.index(1) if 1 in label else 0
                    last = len(label) - 1 - label[::-1].index(1) if 1 in label else 0
                    latest = max(0, len(found) - SEQUENCE)
                    low = max(0, min(first - SEQUENCE // 3, latest))
                    high = max(0, min(last - SEQUENCE * 2 // 3, latest))
                    for begin in (low,) if last < low + SEQUENCE else (low, high):
                        ids.append(page_id)
                        rows.append(features[begin : begin + SEQUENCE])
                        labels.append(label[begin : begin + SEQUENCE])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.list_(pa.int32()))), pa.array(labels, pa.list_(pa.int32()))],
            names=["page_id", "features", "labels"],
        )


def train(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` pages of any length that name their article.

    Pages are taken in the order of a hash of page_id, of repeated ones one. Of a page with more than
    ``SEQUENCE`` blocks windows of that many train, one over the article's start and one over its
    end. Only the numbers of
    block features reach the driver: at most ``sample * (1 + VARIANTS) * 2 * SEQUENCE`` blocks. Without
    such a page the result is ``rule_field()``.
    """
    prepare_workers(pages.sparkSession)
    usable = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where(
        F.col("html").rlike("(?i)<article\\b") & F.col("page_id").isNotNull()
    )
    chosen = usable.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    texts = usable.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    found = texts.mapInArrow(_sequences, "page_id long, features array<array<int>>, labels array<int>").toArrow().to_pylist()
    found.sort(key=lambda r: r["page_id"])
    if not any(1 in r["labels"] for r in found):
        return rule_field()
    return fit([r["features"] for r in found], [r["labels"] for r in found])


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html, others ignored).

    Blocks labelled main text, in page order, joined by two line ends; white space inside a block is
    one space. A null or empty html, and a page without main text, give the empty text. Markup that
    is cut off or badly nested is read as far as it goes. Repeated rows get equal results; an empty
    table gives an empty table.
    """
    prepare_workers(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(page.as_py(), field)) if page.is_valid else "" for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, SCHEMA)
