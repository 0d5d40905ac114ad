"""A small causal self-attention model in numpy: forward, backward, training, scoring.

Token sequences lie in blocks of ``BLOCK`` places.  The context window of a block is the block before
it and itself, so that neighbouring windows overlap by a block; each place is scored once, in the
window whose last block it is in, under a mask that hides later places (and, in the first
block of a sequence, the block before).  All windows of a batch go through the same matrix products.

What hangs on the kind of an input alone (query, key, value and its part of the hidden layer) is a table by kind:
a place looks its row up, and the gradient is summed by kind before it goes back through the weights.

An output is chosen in three steps of ``BRANCHES``: a part of all tokens, a group of the part, a token of the group, slot by slot, so
that the most frequent tokens share groups (of windows kept out, that is the better order as well).  Outputs are
computed for places in the order of their groups, so that the weights of a part or a group meet one piece of an array.
Arrays are worked on piece by piece and kept between calls.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided

BLOCK, DIM, HIDDEN = 16, 16, 32
CLASSES, SLOTS = 64, 64
#: Outputs of a step (three tell all tokens apart), and groups of the last one.
BRANCHES = 16
GROUPS = CLASSES * SLOTS // BRANCHES


def init(inputs: int, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights for tokens numbered class * SLOTS + slot; ``inputs`` kinds of input."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "embed": (rng.standard_normal((inputs, DIM)) * 0.3).astype(np.float32),
        "query": normal(DIM, DIM),
        "key": normal(DIM, DIM),
        "value": normal(DIM, DIM),
        "distance": np.zeros((2 * BLOCK,), np.float32),
        "mix": normal(2 * DIM, HIDDEN),
        "mix_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, BRANCHES),
        "out_bias": np.zeros(BRANCHES, np.float32),
        "middle": (rng.standard_normal((BRANCHES, HIDDEN, BRANCHES)) * 0.05).astype(np.float32),
        "middle_bias": np.zeros((BRANCHES, BRANCHES), np.float32),
        "slot": (rng.standard_normal((GROUPS, HIDDEN, BRANCHES)) * 0.05).astype(np.float32),
        "slot_bias": np.zeros((GROUPS, BRANCHES), np.float32),
    }


def biases(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The biases under which outputs are as likely as their counts (none 0) say, whatever the input."""
    of_groups = counts.reshape(CLASSES, SLOTS).T.reshape(GROUPS, BRANCHES)
    of_parts = of_groups.sum(1).reshape(BRANCHES, BRANCHES)
    share = lambda x: np.log(x / x.sum(-1, keepdims=True)).astype(np.float32)
    return {"out_bias": share(of_parts.sum(1)), "middle_bias": share(of_parts), "slot_bias": share(of_groups)}


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params.values()])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: p.astype(np.float32) for k, p in views(values, like).items()}


def views(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights that ``flat`` put one after the other, as views."""
    out, at = {}, 0
    for k, p in like.items():
        out[k] = values[at : at + p.size].reshape(p.shape)
        at += p.size
    return out


_DISTANCE = np.clip(np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :], 0, None)
_LATER = np.arange(2 * BLOCK)[None, :] > np.arange(BLOCK)[:, None] + BLOCK
_SCALE = np.float32(1 / np.sqrt(DIM))
#: Columns by kind: query, key, value, part of the hidden layer.
_PARTS = slice(0, DIM), slice(DIM, 2 * DIM), slice(2 * DIM, 3 * DIM), slice(3 * DIM, 3 * DIM + HIDDEN)
#: Blocks whose attention is computed at a time.
_NEAR = 256


def blocks_of(sequences: list[np.ndarray], kinds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets in blocks, which blocks are the first of a sequence, and which places are used.

    sequences: tokens to be scored.  The input at a place is the kind of the token before, at first ``start``.
    """
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    blocks = -(-sizes // BLOCK)
    begin = (np.cumsum(blocks) - blocks) * BLOCK
    total = int(blocks.sum()) * BLOCK
    tokens = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.int32)
    places = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(tokens))
    targets, inputs, used = np.zeros(total, np.int32), np.full(total, start, np.int32), np.zeros(total, bool)
    targets[places], used[places] = tokens, True
    inputs[1:][used[1:]] = kinds[targets[:-1][used[1:]]]
    inputs[begin[sizes > 0]] = start
    first = np.zeros(total // BLOCK, bool)
    first[begin[sizes > 0] // BLOCK] = True
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), first, used.reshape(-1, BLOCK)


def _into_tables(p: dict[str, np.ndarray]) -> np.ndarray:
    """Weights from an input to its rows of the tables, one beside the other."""
    return np.concatenate([p["query"] * _SCALE, p["key"], p["value"], p["mix"][:DIM]], 1)


def prepared(p: dict[str, np.ndarray]) -> tuple:
    """What all places share: tables by kind (query; key; value and a one, which sums the attention; part of the hidden layer), biases by distance, and the outputs' weights with their biases as a last row: by part those of the first two steps, by group those of the third."""
    query, key, value, direct = (p["embed"] @ _into_tables(p)[:, x] for x in _PARTS)
    tables = query, key, np.concatenate([value, np.ones((len(value), 1), np.float32)], 1), direct + p["mix_bias"]
    bias = np.where(_LATER, np.float32(-1e4), p["distance"][_DISTANCE])
    with_bias = lambda name: np.concatenate([p[name], p[name + "_bias"][..., None, :]], -2)
    upper = np.concatenate([np.broadcast_to(with_bias("out"), (BRANCHES, HIDDEN + 1, BRANCHES)), with_bias("middle")], 2)
    return tables, bias, upper, with_bias("slot")


def _seen_twice(rows: np.ndarray) -> np.ndarray:
    """Of rows of blocks, one more block than there are windows: each window's two blocks, as a view."""
    return as_strided(rows, (len(rows) // BLOCK - 1, 2 * BLOCK, rows.shape[1]), (BLOCK * rows.strides[0], *rows.strides), writeable=False)


class Work:
    """Arrays that are kept between calls, by name: large ones anew would be mapped, and cleared by the system, each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        """An array of the shape, with anything in it."""
        size = int(np.prod(shape))
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size + size // 4, np.float32)
        return self.held[name][:size].reshape(shape)


def _exp(x: np.ndarray, most: float) -> None:
    """Turns exponents, ``most`` at most, into their powers."""
    if x.size and not x.max() <= most:
        np.minimum(x, np.float32(most), out=x)
    np.exp(x, out=x)


def _attended(query: np.ndarray, key: np.ndarray, value: np.ndarray, bias: np.ndarray, first: np.ndarray, scores: np.ndarray, seen: np.ndarray) -> None:
    """Of rows of the tables: exponents of the attention; what is seen, and the exponents' sum as a last column."""
    np.matmul(query.reshape(-1, BLOCK, DIM), _seen_twice(key).transpose(0, 2, 1), out=scores)
    scores += bias
    _exp(scores, 60)
    scores[first, :, :BLOCK] = 0
    np.matmul(scores, _seen_twice(value), out=seen)
    seen[..., :DIM] /= seen[..., DIM:]


def _hidden(p: dict[str, np.ndarray], direct: np.ndarray, seen: np.ndarray, out: np.ndarray) -> None:
    pre = seen.reshape(-1, DIM + 1)[:, :DIM] @ p["mix"][DIM:]
    pre += direct
    pre *= 2  # the hyperbolic tangent by exponents, which are faster
    _exp(pre, 60)
    pre += 1
    np.divide(-2, pre, out=pre)
    np.add(pre, 1, out=out[:, :HIDDEN])
    out[:, HIDDEN] = 1


def _looked_up(tables: tuple[np.ndarray, ...], inputs: np.ndarray, at: int, upto: int, work: Work, direct: bool = True) -> list[np.ndarray]:
    """Rows of the tables for blocks at to upto; of keys and values, for the block before as well (zeros before the first, without a one: not seen)."""
    out, own = [], inputs[at:upto].ravel()
    for name, table in zip(("query", "key", "value", "direct")[: 3 + direct], tables):
        before = BLOCK * (name in ("key", "value"))
        rows = work(name, before + len(own), table.shape[1])
        np.take(table, own, 0, rows[before:], "clip")
        if before:
            rows[:before] = np.take(table, inputs[at - 1], 0, mode="clip") if at else 0
        out.append(rows)
    return out


def _ranks(tokens: np.ndarray) -> np.ndarray:
    """Tokens numbered slot by slot: the most frequent ones share parts and groups, so that a batch meets few of them."""
    return tokens % SLOTS * CLASSES + tokens // SLOTS


def _by_group(ranks: np.ndarray) -> tuple[np.ndarray, list[tuple[int, list[tuple[int, int, int]]]]]:
    """Order of places by group; of each part that occurs, its groups and their pieces of that order."""
    groups = ranks // BRANCHES
    counts = np.bincount(groups, minlength=GROUPS)
    ends, parts = np.cumsum(counts).tolist(), {}
    for g, n in enumerate(counts.tolist()):
        if n:
            parts.setdefault(g // BRANCHES, []).append((g, ends[g] - n, ends[g]))
    return np.argsort(groups.astype(np.uint16), kind="stable"), list(parts.items())


_ONES = np.ones(BRANCHES, np.float32)


def _steps(hidden: np.ndarray, ranks: np.ndarray, upper: np.ndarray, slot: np.ndarray, pieces: list[tuple[int, int, int]], work: Work) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces of a part, a row for each of the three steps of each place: exponents of the logits, and their sums; where the chosen outputs stand; log probabilities of the places' outputs."""
    begin, end = pieces[0][1], pieces[-1][2]
    logits, ranks = work("logits", end - begin, 3 * BRANCHES), ranks[begin:end]
    np.matmul(hidden[begin:end], upper, out=logits[:, : 2 * BRANCHES])
    for g, a, b in pieces:
        np.matmul(hidden[a:b], slot[g], out=logits[a - begin : b - begin, 2 * BRANCHES :])
    by_step, chosen = logits.reshape(-1, BRANCHES), np.arange(0, logits.size, BRANCHES).reshape(-1, 3)
    for step, size in enumerate((BRANCHES * BRANCHES, BRANCHES, 1)):
        chosen[:, step] += ranks // size % BRANCHES
    own = logits.ravel().take(chosen)
    _exp(by_step, 80)
    total = np.maximum(by_step @ _ONES, np.float32(1e-37))
    own -= np.log(total).reshape(-1, 3)
    return by_step, total, chosen, own.sum(1)


def log_probabilities(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, ready: tuple[np.ndarray, ...] | None = None, work: Work | None = None) -> np.ndarray:
    """Natural log probability of each target.  ready: ``prepared(p)``, if at hand; work: arrays to be used again."""
    (tables, bias, upper, slot), work = ready or prepared(p), work or Work()
    hidden = work("hidden", targets.size, HIDDEN + 1)
    for at in range(0, len(inputs), _NEAR):
        upto = min(at + _NEAR, len(inputs))
        *rows, direct = _looked_up(tables, inputs, at, upto, work)
        seen = work("seen", upto - at, BLOCK, DIM + 1)
        _attended(*rows, bias, first[at:upto], work("scores", upto - at, BLOCK, 2 * BLOCK), seen)
        _hidden(p, direct, seen, hidden[at * BLOCK : upto * BLOCK])
    ranks = _ranks(targets.ravel())
    order, parts = _by_group(ranks)
    hidden, ranks = np.take(hidden, order, 0, work("by group", *hidden.shape), "clip"), ranks[order]
    found = np.empty(targets.size, np.float32)
    for part, pieces in parts:
        found[order[pieces[0][1] : pieces[-1][2]]] = _steps(hidden, ranks, upper[part], slot, pieces, work)[3]
    return found.reshape(targets.shape)


def loss_and_gradient(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, used: np.ndarray, work: Work | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log probability of the used places, and its gradient."""
    (tables, bias, upper, slot), work = prepared(p), work or Work()
    n = len(inputs)
    near = [(at, min(at + _NEAR, n)) for at in range(0, n, _NEAR)]
    hidden, all_seen, all_scores = work("hidden", targets.size, HIDDEN + 1), work("all seen", n, BLOCK, DIM + 1), work("all scores", n, BLOCK, 2 * BLOCK)
    for at, upto in near:
        *rows, direct = _looked_up(tables, inputs, at, upto, work)
        _attended(*rows, bias, first[at:upto], all_scores[at:upto], all_seen[at:upto])
        _hidden(p, direct, all_seen[at:upto], hidden[at * BLOCK : upto * BLOCK])
    places = np.flatnonzero(used)
    ranks = _ranks(targets.ravel()[places])
    order, parts = _by_group(ranks)
    places, ranks, count = places[order], ranks[order], len(places)
    by_group, d_by_group = np.take(hidden, places, 0, work("by group", count, HIDDEN + 1), "clip"), work("d by group", count + 1, HIDDEN)
    loss, share, d_upper, d_slot = 0.0, np.float32(1 / max(1, count)), np.zeros_like(upper), np.zeros_like(slot)
    for part, pieces in parts:
        begin, end = pieces[0][1], pieces[-1][2]
        by_step, total, chosen, own = _steps(by_group, ranks, upper[part], slot, pieces, work)
        loss -= float(own.sum(dtype=np.float64))
        by_step *= (share / total)[:, None]
        by_step.ravel()[chosen] -= share
        d_logits, of_part, d_of_part = by_step.reshape(-1, 3 * BRANCHES), by_group[begin:end], d_by_group[begin:end]
        np.matmul(of_part.T, d_logits[:, : 2 * BRANCHES], out=d_upper[part])
        np.matmul(d_logits[:, : 2 * BRANCHES], upper[part, :HIDDEN].T, out=d_of_part)
        d_last = work("d last", end - begin, HIDDEN)
        for g, a, b in pieces:
            d = d_logits[a - begin : b - begin, 2 * BRANCHES :]
            np.matmul(by_group[a:b].T, d, out=d_slot[g])
            np.matmul(d, slot[g, :HIDDEN].T, out=d_last[a - begin : b - begin])
        d_of_part += d_last
        slope = np.square(of_part[:, :HIDDEN], out=d_last)
        d_of_part *= np.subtract(1, slope, out=slope)
    d_by_group[count] = 0  # of places that are not used
    at_group = np.full(targets.size, count)
    at_group[places] = np.arange(count)
    d_mix, d_bias, d_mix_bias, into = np.zeros_like(p["mix"]), np.zeros_like(bias), np.zeros_like(p["mix_bias"]), _into_tables(p)
    d_into, d_x = np.zeros_like(into), work("d inputs", DIM, targets.size)
    after = np.zeros((2, BLOCK, DIM), np.float32)  # what the blocks after give keys and values of the last block of these: they go from the last to the first
    for at, upto in reversed(near):
        m, scores, seen, here = upto - at, all_scores[at:upto], all_seen[at:upto], slice(at * BLOCK, upto * BLOCK)
        query, key, value = _looked_up(tables, inputs, at, upto, work, direct=False)
        d = np.take(d_by_group, at_group[here], 0, work("d hidden", m * BLOCK, HIDDEN), "clip")
        d_mix_bias += d.sum(0)
        d_mix[DIM:] += seen.reshape(-1, DIM + 1)[:, :DIM].T @ d
        d_seen = work("d seen", m, BLOCK, DIM + 1)
        np.divide((d @ p["mix"][DIM:].T).reshape(m, BLOCK, DIM), seen[..., DIM:], out=d_seen[..., :DIM])
        d_seen[..., DIM] = -np.einsum("ijk,ijk->ij", d_seen[..., :DIM], seen[..., :DIM])
        d_scores = np.matmul(d_seen, _seen_twice(value).transpose(0, 2, 1), out=work("d scores", m, BLOCK, 2 * BLOCK))
        d_scores *= scores
        d_bias += d_scores.sum(0)
        d_query = np.matmul(d_scores, _seen_twice(key), out=work("d query", m, BLOCK, DIM)).reshape(-1, DIM)
        d_rows = [d_query]
        for weights, values, given in ((d_scores, query.reshape(m, BLOCK, DIM), after[0]), (scores, d_seen[..., :DIM], after[1])):
            flow = np.matmul(weights.transpose(0, 2, 1), values, out=work(f"flow {len(d_rows)}", m, 2 * BLOCK, DIM))
            own = flow[:, BLOCK:]
            own[:-1] += flow[1:, :BLOCK]
            own[-1] += given
            given[...] = flow[0, :BLOCK]
            own_rows = work(f"d {len(d_rows)}", m, BLOCK, DIM)
            own_rows[...] = own
            d_rows.append(own_rows.reshape(-1, DIM))
        d_rows.append(d)
        x, d_inputs = np.take(p["embed"], inputs[at:upto].ravel(), 0, work("inputs", m * BLOCK, DIM), "clip"), d_x[:, here]
        for part, d_part in zip(_PARTS, d_rows):
            d_into[:, part] += x.T @ d_part
        np.matmul(into[:, _PARTS[0]], d_rows[0].T, out=d_inputs)
        for part, d_part in zip(_PARTS[1:], d_rows[1:]):
            d_inputs += into[:, part] @ d_part.T
    d_mix[:DIM] = d_into[:, _PARTS[3]]
    d_embed = np.stack([np.bincount(inputs.ravel(), column, len(p["embed"])) for column in d_x], 1).astype(np.float32)
    d_out = d_upper[..., :BRANCHES].sum(0)
    return loss * float(share), {
        "embed": d_embed,
        "query": d_into[:, _PARTS[0]] * _SCALE,
        "key": d_into[:, _PARTS[1]],
        "value": d_into[:, _PARTS[2]],
        "distance": np.bincount(_DISTANCE.ravel(), np.where(_LATER, 0, d_bias).ravel(), 2 * BLOCK).astype(np.float32),
        "mix": d_mix,
        "mix_bias": d_mix_bias,
        "out": d_out[:-1],
        "out_bias": d_out[-1],
        "middle": d_upper[:, :-1, BRANCHES:],
        "middle_bias": d_upper[:, -1, BRANCHES:],
        "slot": d_slot[:, :-1],
        "slot_bias": d_slot[:, -1],
    }


def train(params: dict[str, np.ndarray], sequences: list[np.ndarray], kinds: np.ndarray, start: int, rate: float, batch: int = 64, epochs: int = 1, seed: int = 5) -> dict[str, np.ndarray]:
    """Stochastic gradient descent with moment estimates over the sequences."""
    values = flat(params).astype(np.float32)
    p = views(values, params)
    m, s, g, work = (np.zeros_like(values) for _ in range(4))
    gradient = views(g, params)
    rng, step, arrays = np.random.default_rng(seed), 0, Work()
    total = max(1, epochs * -(-len(sequences) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for i in range(0, len(order), batch):
            inputs, targets, first, used = blocks_of([sequences[j] for j in order[i : i + batch]], kinds, start)
            step += 1
            now = rate * (1 - (step - 1) / total)
            for k, found in loss_and_gradient(p, inputs, targets, first, used, arrays)[1].items():
                gradient[k][...] = found
            m += np.multiply(np.subtract(g, m, out=work), np.float32(0.1), out=work)
            s += np.multiply(np.subtract(np.square(g, out=g), s, out=work), np.float32(0.02), out=work)
            np.sqrt(np.multiply(s, np.float32(1 / (1 - 0.98**step)), out=work), out=work)
            work += np.float32(1e-8)
            values -= np.multiply(np.divide(m, work, out=work), np.float32(now / (1 - 0.9**step)), out=work)
    return {k: v.copy() for k, v in p.items()}
