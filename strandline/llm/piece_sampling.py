"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text is a lattice of vocabulary pieces. Its segmentations have the product of their pieces'
probabilities, and each is given an independent Gumbel perturbation, implicitly: the search is
best-first (A*) over sets of segmentations with a common beginning, and the key of such a set is its
largest perturbed value, sampled top-down. The first path follows the largest value, which is
ancestral sampling; what is left aside at each of its steps is one set, whose largest value is a Gumbel
variable truncated at that of the path. The set with the largest value is opened next, so the
segmentations come out distinct and in order of their perturbed values, a sample without replacement. The
value that would come next is the threshold for the inclusion score 1 - exp(-exp(log p - threshold)).

Random numbers are hashes of the seed, the row's key and text and the place, so they do not depend on partitions.
Pieces hold white space only in front, so the lattice falls into words; the lattice of a word (its
sums over all segmentations, by a backward pass) is computed once a slice of texts, and words that
repeat are sampled anew each time. For vocabularies of merges, whose scores are ranks, a piece's
log probability is -log(rank + 2.7) (Zipf); for others it is its score.

Characters that no piece covers are spelt in byte pieces. As in the library, a text is given one
leading space and spaces become U+2581, so decoding gives back every text without U+2581 in it.
Null and empty texts have one empty segmentation of probability 1; a lattice with fewer than k segmentations gives all.
Repeated rows give equal samples. Null keys are allowed. Empty table: empty result.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, give_back, mix, ranges, slices, table, text_buffers, uniform

SAMPLES, SEED, SLICE, SPACE = 2, 17, 1 << 19, "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class Pieces:
    """The vocabulary as a trie in sorted arrays, with piece scores and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        texts = [sp.id_to_piece(i) for i in own]
        scores = np.array([sp.get_score(i) for i in own])
        if np.all(scores == np.round(scores)):  # ranks of merges
            rank = np.empty(len(own))
            rank[np.argsort(-scores, kind="stable")] = np.arange(len(own))
            logp = -np.log(rank + 2.7)
        else:
            logp = scores
        self.whole = any("\n" in t or SPACE in t.lstrip(SPACE) for t in texts)  # pieces that cross words: no cutting
        self.logp = np.full(n, float(logp.min()))
        self.logp[own] = logp
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        edges: dict[tuple[int, int], int] = {}
        ends, states = {}, 1
        for i, t in zip(own, texts, strict=True):
            s = 0
            for c in t:
                key = (s, ord(c))
                if key not in edges:
                    edges[key] = states
                    states += 1
                s = edges[key]
            ends[s] = i
        keys = np.array([(s << 21) | c for s, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.end = np.full(states, -1, np.int64)
        for s, i in ends.items():
            self.end[s] = i
        self.longest = max(map(len, texts))
        self._table(states)
        raw = [b""] * n
        for i, t in zip(own, texts, strict=True):
            raw[i] = t.encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.size = np.array([len(x) for x in raw], np.int64)
        self.at, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)

    def _table(self, states: int) -> None:
        """The trie with rows of children laid over each other: that of state s by class c is to at base[s] + c, if own says s there."""
        state, char = self.keys >> 21, self.keys & ((1 << 21) - 1)
        chars, c = np.unique(char, return_inverse=True)
        c += 1  # class 0 is of characters in no piece
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[chars] = np.arange(1, len(chars) + 1)
        first = np.flatnonzero(np.append(True, state[1:] != state[:-1])) if len(state) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(state)))
        self.base = np.zeros(states, np.int32)
        used, most = np.zeros(2 * len(chars) + 2 * len(state) + 4096, bool), len(chars) + 1
        b, last = 0, 0
        for g in np.argsort(-size, kind="stable").tolist():
            if size[g] == 1:
                break
            own, b, last = c[first[g] : first[g] + size[g]], b if size[g] == last else 0, size[g]  # of one size, each after the one before
            while True:
                if b + most + 64 > len(used):
                    used = np.concatenate([used, np.zeros(len(used), bool)])
                free = np.flatnonzero(~used[np.arange(b, b + 64)[:, None] + own].any(1))
                if len(free):
                    break
                b += 64
            b += int(free[0])
            used[b + own] = True
            self.base[state[first[g]]] = b
        alone = first[size == 1]
        used = np.concatenate([used, np.zeros(len(alone) + most, bool)])
        spots = most + np.flatnonzero(~used[most:])[: len(alone)]
        self.base[state[alone]] = spots - c[alone]
        at = self.base[state] + c
        self.own, self.over = np.full(int(self.base.max()) + most + 1, -1, np.int32), np.zeros(int(self.base.max()) + most + 1, np.int32)
        self.own[at], self.over[at] = state, self.to

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.at[ids], self.size[ids])]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode().replace(SPACE, " ")[1:]

    def units(self, text: str) -> list[str]:
        """The words of a text's lattice; nothing for the empty text."""
        if not text:
            return []
        norm = SPACE + text.replace(" ", SPACE)
        return [norm] if self.whole else _UNITS.findall(norm)

    def cut(self, texts) -> tuple:
        """The units of an Arrow array of texts as one Arrow array, spaces not yet U+2581, and their number in each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        raw, start, end = text_buffers(pc.replace_substring(pc.fill_null(texts, ""), SPACE, " "))
        size = end - start
        full = size > 0
        stop = np.cumsum(size + full)
        begin = (stop - size - full)[full]
        data = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
        body = np.ones(len(data), bool)
        body[begin] = False
        if len(begin):
            data[body] = raw[start[0] : end[-1]]
        head = np.zeros(len(data), bool)
        if not self.whole and len(data):
            space, line = data == 32, data == 10
            head |= line
            head[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        head[begin] = True
        at = np.append(np.flatnonzero(head), len(data))
        number = np.diff(np.searchsorted(at[:-1], np.append(0, stop)))
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)), number


@functools.cache
def _pieces(path: str) -> Pieces:
    """The vocabulary of a model's file, read once by a worker."""
    return Pieces(path)


class Lattice:
    """Lattices of distinct words: arcs by node, with the chance of each arc given its node.

    A node is the place before a character. Nodes are in order of their distance from the word's end, in each distance the
    longest word first, so all that a distance needs for its sums lies together; the node behind every word is `stop`.
    """

    def __init__(self, pieces: Pieces, words):
        import pyarrow.compute as pc

        raw, begin, end = text_buffers(words)
        cp = np.frombuffer((raw[begin[0] : end[-1]].tobytes() if len(words) else b"").decode().encode("utf-32-le"), np.uint32).astype(np.int32)
        cp[cp == 32] = ord(SPACE)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        total = self.stop = len(cp)
        far = int(size.max()) if total else 0
        wide = np.append(len(size), len(size) - np.cumsum(np.bincount(size, minlength=far + 1))[:-1]) if total else np.zeros(1, np.int64)  # words of at least so many characters
        off = np.concatenate([[0, 0], np.cumsum(wide[1:])])  # first node of a distance
        rank = np.empty(len(size), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
        self.start = off[size] + rank
        node = off[np.repeat(np.cumsum(size), size) - np.arange(total)] + np.repeat(rank, size)
        char = np.full(total + 1, -1, np.int32)
        char[node] = cp
        after = np.full(total + 1, total, np.int32)
        if far > 1:
            after[off[2] : total] = np.arange(off[2], total) - np.repeat(wide[1:far], wide[2:])
        group = np.append(pieces.classes[char[:total]], 0).astype(np.int32)
        del cp, node
        # Pieces that begin at each node, shorter ones first.
        arcs, count = [], np.zeros(total, np.int32)
        state = np.where(pieces.own[pieces.base[0] + group[:total]] == 0, pieces.over[pieces.base[0] + group[:total]], 0)
        frm = np.flatnonzero(state).astype(np.int32)
        state, at = state[frm], after[frm]
        ends = pieces.end.astype(np.int32)
        while len(frm):
            piece = ends[state]
            full = np.flatnonzero(piece >= 0)
            own = frm[full]
            arcs.append((own, count[own], at[full], piece[full]))
            count[own] += 1
            slot = pieces.base[state] + group[at]
            go = np.flatnonzero(pieces.own[slot] == state)
            frm, state, at = frm[go], pieces.over[slot[go]], after[at[go]]
        covered = np.zeros(total, bool)
        covered[arcs[0][0] if arcs else slice(0)] = True
        bare = np.flatnonzero(~covered)
        if len(bare):
            arcs.append((bare, count[bare], after[bare], -1 - char[bare]))
            count[bare] += 1
        self.degree = count.astype(np.int64)
        self.first = np.append(0, np.cumsum(self.degree))
        n_arcs = int(self.first[-1])
        self.goal, self.piece = np.empty(n_arcs, np.int32), np.empty(n_arcs, np.int32)
        for own, turn, goal, piece in arcs:
            to = self.first[own] + turn
            self.goal[to], self.piece[to] = goal, piece
        del arcs, group, after
        self.frm = np.repeat(np.arange(total, dtype=np.int32), self.degree)
        logp = pieces.logp[np.maximum(self.piece, 0)]
        spelt = np.flatnonzero(self.piece < 0)
        if len(spelt):
            c = -1 - self.piece[spelt]
            logp[spelt] = (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)) * pieces.logp.min()
        # Backward sums, one distance from the end after the other.
        back = np.zeros(total + 1)
        self.logc, self.upto = np.empty(n_arcs), np.empty(n_arcs)  # log chance of an arc at its node; chances up to it
        for x, y in zip(off[1:-1].tolist(), off[2:].tolist(), strict=True):
            a, z = int(self.first[x]), int(self.first[y])
            head, degree = self.first[x:y] - a, self.degree[x:y]
            v = logp[a:z] + back[self.goal[a:z]]
            top = np.maximum.reduceat(v, head)
            chance = np.exp(v - np.repeat(top, degree))
            s = np.add.reduceat(chance, head)
            back[x:y] = top + np.log(s)
            self.logc[a:z] = v - np.repeat(back[x:y], degree)
            chance /= np.repeat(s, degree)
            run = np.cumsum(chance)
            self.upto[a:z] = run - np.repeat(run[head] - chance[head], degree)

    def p(self, arcs: np.ndarray) -> np.ndarray:
        return np.exp(self.logc[arcs])

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc of each node by its chance."""
        arc, lastly = self.first[node], self.first[node] + self.degree[node] - 1
        open_ = np.arange(len(node))
        while len(open_):
            a = arc[open_]
            open_ = open_[(a < lastly[open_]) & (self.upto[a] < u[open_])]
            arc[open_] += 1
        return arc


def _noise(key: np.ndarray, sample: int, step: np.ndarray, stream: int, turn: int = 0) -> np.ndarray:
    """Uniform numbers for the place step, the turn there, the sample and the stream: each is hashed in on its own, so none meets another."""
    x = mix(key + mix(step.astype(U) + U(0x9E3779B97F4A7C15)))
    return uniform(mix(mix(x + U(turn)) ^ mix(np.full(1, sample, U) * U(0xC2B2AE3D27D4EB4F) + U(stream))))


def _truncated(phi: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of locations phi given that they are below top."""
    return phi - np.log(np.exp(np.minimum(phi - top, 700.0)) - np.log(u))


class Path:
    """One segmentation of each text of a slice: steps (arcs) text by text, with cumulated log chances."""

    def __init__(self, lattice: Lattice, arcs: np.ndarray, count: np.ndarray, occ: np.ndarray):
        self.arc, self.count, self.occ = arcs, count, occ
        self.first = np.cumsum(count) - count
        logc = lattice.logc[arcs]
        run = np.concatenate([np.zeros(1), np.cumsum(logc)])
        base = np.repeat(run[self.first], count)
        self.before, self.total = run[:-1] - base, run[self.first + count] - run[self.first]
        self.text = np.repeat(np.arange(len(count), dtype=np.int32), count)


def _walk(lattice: Lattice, node: np.ndarray, key: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Ancestral samples from nodes to the ends of their words: (arcs, number of arcs of each), in order."""
    live, steps = np.arange(len(node)), []
    at, t = node.copy(), 0
    while len(live):
        arc = lattice.choose(at, _noise(key[live], sample, place[live], 0, t))
        steps.append((live, arc))
        nxt = lattice.goal[arc]
        go = nxt < lattice.stop
        live, at, t = live[go], nxt[go], t + 1
    count = np.zeros(len(node), np.int64)
    for own, _ in steps:
        count[own] += 1
    first = np.cumsum(count) - count
    arcs = np.empty(int(count.sum()), np.int64)
    for t, (own, arc) in enumerate(steps):
        arcs[first[own] + t] = arc
    return arcs, count


#: Words that are sampled at a time; the lattice of their words is shared by a whole slice.
PART_WORDS = 40_000


def sample_slice(pieces: Pieces, texts, keys: np.ndarray, k: int):
    """For each text (a list or an Arrow array) its samples in order: [(ids, log probability, perturbed value, inclusion score)]."""
    import pyarrow as pa

    units, n_units = pieces.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    coded = units.dictionary_encode()
    del units
    occ = coded.indices.to_numpy(zero_copy_only=False)
    lattice = Lattice(pieces, coded.dictionary)
    upto, out = np.cumsum(n_units), []
    for i, j in slices(upto - n_units, upto, PART_WORDS):
        out += _sample_part(pieces, lattice, occ[upto[i] - n_units[i] : upto[j - 1]].astype(np.int64), n_units[i:j], keys[i:j], k)
    return out


def _sample_part(pieces: Pieces, lattice: Lattice, occ: np.ndarray, n_units: np.ndarray, keys: np.ndarray, k: int):
    texts = range(len(n_units))
    of_text = np.repeat(np.arange(len(texts)), n_units)
    unit_first = np.cumsum(n_units) - n_units
    place = np.arange(len(occ)) - unit_first[of_text]
    node = lattice.start[occ] if len(occ) else occ
    root = -np.log(-np.log(uniform(mix(keys + U(1)))))
    arcs, count = _walk(lattice, node, keys[of_text], place, 0)
    per_text = np.bincount(of_text, count, len(texts)).astype(np.int64)
    path = Path(lattice, arcs, per_text, np.repeat(np.arange(len(occ)), count))
    phi = path.before + np.log(np.maximum(1 - lattice.p(path.arc), 1e-300))
    alone = lattice.degree[lattice.frm[path.arc]] == 1
    step = np.arange(len(arcs)) - path.first[path.text]
    rest = np.where(alone, -np.inf, _truncated(phi, root[path.text], _noise(keys[path.text], 0, step, 1)))
    paths, rests, gain = [path], [rest], [root]
    out: list[list] = [[(0, float(root[x]))] for x in range(len(texts))]
    for r in range(1, k + 1):
        best, which = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        for j, (p, g) in enumerate(zip(paths, rests, strict=True)):
            full = p.count > 0
            top = np.full(len(texts), -np.inf)
            if full.any():
                top[full] = np.maximum.reduceat(g, p.first[full])
            which[top > best] = j
            best = np.maximum(best, top)
        if r == k:
            break
        open_ = np.flatnonzero(best > -np.inf)
        pre_arcs, pre_count, turn, turn_occ, turn_step = {}, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        left_phi = np.full(len(texts), -np.inf)
        for x in open_.tolist():
            p, g = paths[which[x]], rests[which[x]]
            a = int(p.first[x])
            turn_step[x] = int(np.argmax(g[a : a + p.count[x]]))
        noise = _noise(keys[open_], r, turn_step[open_], 2)
        for x, u in zip(open_.tolist(), noise.tolist(), strict=True):
            p, s = paths[which[x]], int(turn_step[x])
            a = int(p.first[x])
            here = int(lattice.frm[p.arc[a + s]])
            choices = np.arange(lattice.first[here], lattice.first[here] + lattice.degree[here])
            prefix = p.arc[a : a + s]
            taken = {int(q.arc[q.first[x] + s]) for q in paths if q.count[x] > s and np.array_equal(q.arc[q.first[x] : q.first[x] + s], prefix) and lattice.frm[q.arc[q.first[x] + s]] == here}
            choices = np.array([c for c in choices.tolist() if c not in taken])
            chance = np.cumsum(lattice.p(choices))
            pick = int(min(np.searchsorted(chance, u * chance[-1]), len(choices) - 1))
            turn[x], turn_occ[x] = choices[pick], p.occ[a + s]
            pre_arcs[x], pre_count[x] = prefix, s
            remain = float(chance[-1] - lattice.p(choices[pick]))
            if len(choices) > 1 and remain > 0:
                left_phi[x] = float(p.before[a + s]) + np.log(remain)
        if not len(open_):
            break
        # The rest of the word after the turn, and all words behind it, anew.
        went = lattice.goal[turn[open_]]
        part = went < lattice.stop
        follow = ranges(turn_occ[open_] + 1, (unit_first + n_units)[open_] - turn_occ[open_] - 1)
        start = np.concatenate([went[part], lattice.start[occ[follow]]])
        who = np.concatenate([open_[part], of_text[follow]])
        where = np.concatenate([turn_occ[open_[part]], follow])
        order = np.argsort(where, kind="stable")
        start, who, where = start[order], who[order], where[order]
        arcs, count = _walk(lattice, start, keys[who], place[where], r)
        new_count = np.bincount(who, count, len(texts)).astype(np.int64)
        total = np.zeros(len(texts), np.int64)
        total[open_] = pre_count[open_] + 1 + new_count[open_]
        first = np.cumsum(total) - total
        all_arcs, all_occ = np.empty(int(total.sum()), np.int64), np.empty(int(total.sum()), np.int64)
        behind = ranges(first[open_] + pre_count[open_] + 1, new_count[open_])
        all_arcs[behind], all_occ[behind] = arcs, np.repeat(where, count)
        for x in open_.tolist():
            f, s = int(first[x]), int(pre_count[x])
            p = paths[which[x]]
            all_arcs[f : f + s], all_occ[f : f + s] = pre_arcs[x], p.occ[p.first[x] : p.first[x] + s]
            all_arcs[f + s], all_occ[f + s] = turn[x], turn_occ[x]
        path = Path(lattice, all_arcs, total, all_occ)
        step = np.arange(len(all_arcs)) - path.first[path.text]
        alone = lattice.degree[lattice.frm[path.arc]] == 1
        phi = path.before + np.log(np.maximum(1 - lattice.p(path.arc), 1e-300))
        turned = first[open_] + pre_count[open_]
        phi[turned] = left_phi[open_]
        dead = alone | (step < pre_count[path.text]) | ~np.isfinite(phi)  # sets in front of the turn belong to the older path
        rest = np.where(dead, -np.inf, _truncated(np.where(dead, -1e300, phi), best[path.text], _noise(keys[path.text], r, step, 1)))
        for x in open_.tolist():
            p = paths[which[x]]
            rests[which[x]][int(p.first[x]) + int(turn_step[x])] = -np.inf  # opened: what is left of it is the new path's
        paths.append(path)
        rests.append(rest)
        for x in open_.tolist():
            out[x].append((len(paths) - 1, float(best[x])))
    ids = [_ids(pieces, lattice, p) for p in paths]
    result = []
    for x in range(len(texts)):
        rows = []
        for j, value in out[x]:
            i, n = ids[j]
            logp = float(paths[j].total[x])
            threshold = float(best[x])
            included = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(logp - threshold, 700.0))))
            rows.append((i[n[x] : n[x + 1]], logp, value, included))
        result.append(rows)
    return result


def _ids(pieces: Pieces, lattice: Lattice, path: Path) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, first id of each), characters without a piece spelt in bytes."""
    piece = lattice.piece[path.arc]
    upto = path.first
    bare = np.flatnonzero(piece < 0)
    if not len(bare):
        return piece, np.append(upto, len(piece))
    spelt = [chr(-1 - c).encode() for c in piece[bare].tolist()]
    n = np.ones(len(piece), np.int64)
    n[bare] = [len(b) for b in spelt]
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    out[at] = piece
    out[ranges(at[bare], n[bare])] = pieces.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
    return out, np.append(np.append(at, len(out))[upto], len(out))


SCHEMA = "doc_id {kind}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean, ids_crc32 long"


def sample_pieces(docs: DataFrame, model_path: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, with_ids: bool = False, slice_bytes: int = SLICE) -> DataFrame:
    """One row per document and sample, samples from 1: counts, scores, a digest, and with_ids the ids.

    round_trip says that decoding the ids gave the text back.
    """

    def run(batches):
        import pyarrow as pa

        pieces = _pieces(model_path)
        for batch in batches:
            _, start, end = text_buffers(batch.column(1))
            for i, j in slices(start, end, slice_bytes):
                texts = batch.column(1).slice(i, j - i)
                keys = mix(batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).view(U))
                found = sample_slice(pieces, texts, keys, k)
                flat = np.concatenate([ids for samples in found for ids, *_ in samples]).astype("<u4")
                coded, decoded = memoryview(flat.tobytes()), pieces.decode_bytes(flat).tobytes()
                upto = np.append(0, np.cumsum(pieces.size[flat]))
                rows, at = [], 0
                for x, (text, samples) in enumerate(zip(texts.to_pylist(), found, strict=True)):
                    want = (SPACE + text.replace(" ", SPACE)).encode() if text else b""
                    for s, (ids, logp, value, included) in enumerate(samples):
                        to = at + len(ids)
                        rows.append((x, s + 1, len(ids), logp, value, included, decoded[upto[at] : upto[to]] == want, zlib.crc32(coded[4 * at : 4 * to]), ids.tolist() if with_ids else None))
                        at = to
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
                arrays = [batch.column(0).slice(i, j - i).take(pa.array(cols[0])), *[pa.array(c, kind) for c, kind in zip(cols[1:8], kinds, strict=True)]]
                names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(cols[8], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
        give_back()

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key"))
    schema = SCHEMA.format(kind=own.schema["doc_id"].dataType.simpleString())
    return own.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"), model_path())
