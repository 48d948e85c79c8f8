"""Plain-Python models written from the definitions: invariants of the admission, labelled token
positions for packing and splitting, greatest period below a depth.  They check the Spark plans."""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate, groupby

TOKEN_RE = re.compile(r"[^ \t\n\r.]+|[.]|[ \t\n\r]+")
RATIO = 3.68


def order_key(doc_id, seed=42):
    return hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()


def coin(doc_id, seed=15213):
    return int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)


def tokens(text):
    return TOKEN_RE.findall(text)


def token_id(tok):
    return int(hashlib.md5(tok.encode()).hexdigest()[:7], 16)


def sample_model(docs, total_tokens, mode, mix=None, ratio=0.1, threshold=512):
    """Admission stated by its invariants; docs: (doc_id, source, n_chars).

    A document is *long enough* when it has ``threshold`` estimated tokens or wins its coin.  With a
    mix, a source stays *open* at a document while its earlier long-enough documents sum to at most
    its budget, and the scan ends at the document at which the last source reaches its budget;
    otherwise it ends at the first document that brings the total of the admitted above the budget.
    Returns (admitted ids in order, rows scanned, counters)."""
    stream = sorted(docs, key=lambda d: order_key(d[0]))
    length = [n / RATIO for _, _, n in stream]
    enough = [x >= threshold or coin(d[0]) / 2 ** 32 <= ratio for d, x in zip(stream, length)]
    counters = {s: {"filtered": 0, "passed": 0} for s, _ in mix or []}
    if mode in ("global", "none"):
        take = [mode == "none" or e for e in enough]
        total = list(accumulate(x if t else 0.0 for x, t in zip(length, take)))
        end = next((i + 1 for i, t in enumerate(total) if t > total_tokens), len(stream))
    else:
        take, full = [False] * len(stream), []
        for source, weight in mix:
            budget = total_tokens * weight
            own = [i for i, d in enumerate(stream) if d[1] == source]
            before = list(accumulate((length[i] if enough[i] else 0.0 for i in own), initial=0.0))
            for i, used in zip(own, before):
                take[i] = enough[i] and used <= budget
            full.append(next((i for i, used in zip(own, before[1:]) if take[i] and used >= budget), len(stream)))
        end = min(max(full) + 1, len(stream))
        for i, (_, source, _) in enumerate(stream[:end]):
            used = sum(length[j] for j in range(i) if take[j] and stream[j][1] == source)
            if used <= total_tokens * dict(mix)[source]:
                counters[source]["passed" if enough[i] else "filtered"] += 1
    return [d[0] for d, t in zip(stream[:end], take) if t], end, counters


def _runs(labels):
    """Run-length spans ``(label, start, end)`` of a label per position."""
    at = 0
    for label, group in groupby(labels):
        n = len(list(group))
        yield label, at, at + n
        at += n


def pack_model(token_lists, sources, chunk_size):
    """Chunks of one endless token sequence whose positions carry their document.

    Chunk ``m`` exists when position ``(m + 1) * chunk_size`` does, which is its label."""
    position = [(d, t) for d, toks in enumerate(token_lists) for t in toks]
    out = []
    for m in range(max(0, (len(position) - 1) // chunk_size)):
        part = position[m * chunk_size:(m + 1) * chunk_size]
        spans = [(sources[d], s, e) for d, s, e in _runs([d for d, _ in part])]
        out.append(([t for _, t in part], position[(m + 1) * chunk_size][1], spans))
    return out


def cut_spans(spans, size):
    """Label every position of the spans, cut the labelled positions at ``size``."""
    kept, carried = [], []
    for src, s, e in spans:
        positions = range(s, e)
        for part, shift, out in (([p for p in positions if p < size], 0, kept),
                                 ([p for p in positions if p >= size], size, carried)):
            if part:
                out.append((src, part[0] - shift, part[-1] + 1 - shift))
    return kept, carried


def needle_at_token(ctx, needle, length, depth, buffer=200, periods=(".",)):
    """The needle goes after the greatest period below the depth (0 without one; 100: the end)."""
    room = length - buffer - len(needle)
    ctx = ctx[:length] if len(ctx[:length]) <= room else ctx[:max(room, 0)]
    below = ctx[:int(len(ctx) * (depth / 100))]
    at = len(ctx) if depth == 100 else max((i + 1 for i, t in enumerate(below) if t in periods), default=0)
    return at, ctx[:at] + needle + ctx[at:]


def needle_at_sentence(context, needle, depth):
    """The needle replaces nothing: it follows the period that ends the sentence at the depth."""
    ends = [m.start() for m in re.finditer("[.]", context)]
    place = int(depth * (len(ends) + 1))
    left = "" if place == 0 else context if place > len(ends) else context[:ends[place - 1]]
    right = context if place == 0 else "" if place > len(ends) else context[ends[place - 1] + 1:]
    return left + "." + needle + right


def normalize_answer(s):
    """The words of a lower-cased text without its ASCII punctuation, apart from the articles.

    An article counts where no word character touches it, so the classes of characters decide."""
    kept = [c for c in s.lower() if not (c.isascii() and c.isprintable() and not c.isalnum() and c != " ")]
    out = []
    for is_word, run in groupby(kept, key=lambda c: c.isalnum() or c == "_"):
        run = "".join(run)
        out.append(" " if is_word and run in ("a", "an", "the") else run)
    return " ".join("".join(out).split())


def f1(pred, gt):
    """Twice the matched tokens over all tokens, matched by walking both sorted lists."""
    p, g, same = sorted(pred, reverse=True), sorted(gt, reverse=True), 0
    while p and g:
        if p[-1] == g[-1]:
            same += 1
            p.pop(), g.pop()
        else:
            (p if p[-1] < g[-1] else g).pop()
    return 2 * same / (len(pred) + len(gt)) if same else 0


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(cur[-1], prev[j]))
        prev = cur
    return prev[-1]
