"""Runs of words that are similar to given skeletons, by bounds on common letters before the similarity itself."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np

#: Letters of a piece at most, of a block of the text, and candidates that are worked on together.
PIECE, WIDTH, TOGETHER = 8, 4, 1 << 16


def pieces(skel: str, known: set[str]) -> list[str]:
    """The skeleton cut into pieces: the longest known word at each place, else what lies before the next one, four letters at a time."""
    out, at, loose = [], 0, ""
    while at < len(skel):
        n = next((n for n in range(min(PIECE, len(skel) - at), 2, -1) if skel[at : at + n] in known), 0)
        if n == 0:
            loose, at = loose + skel[at], at + 1
        if loose and (n or len(loose) == 4 or at == len(skel)):
            out.append(loose)
            loose = ""
        if n:
            out.append(skel[at : at + n])
            at += n
    return out


def _best(piece: list[int], letters: np.ndarray, codes: int) -> np.ndarray:
    """For each block of the text, the most that a piece can score with letters that end in it: 8 per common letter, less 3 for each letter of both."""
    m = len(piece)
    mask = np.zeros(codes, np.uint8)
    for k, c in enumerate(reversed(piece)):
        mask[c] |= 1 << k
    x = mask[letters]
    v = np.full(len(x), 255, np.uint8)
    best = np.full(len(x), -3 * m, np.int8)
    for n in range(1, 8 * m // 3 + 1):
        # Row e reads the letter n before the end e.
        u = v[n - 1 :] & x[: len(x) - n + 1]
        w = v[n - 1 :]
        np.bitwise_or(w + u, w - u, out=w)
        score = np.bitwise_count(~w).astype(np.int8)
        score *= 8
        score -= 3 * (n + m)
        np.maximum(best[n - 1 :], score, out=best[n - 1 :])
    return best.reshape(-1, WIDTH).max(axis=1).astype(np.int16)


def ends(skeletons: list[list[str]], coded: dict[str, int], letters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each skeleton, given as pieces in sorted order, the blocks in which a run can end that has letters enough in common.

    A run is cut into parts that belong to the pieces, and its score is the sum of theirs, each at most
    the best of its piece there. A part of more than 8/3 of its piece's letters scores less than none would, and 3 less for each letter more.
    """
    tables: dict[str, np.ndarray] = {}
    stack: list[tuple[str, int, np.ndarray]] = []
    codes = len(coded) + 1
    for k, skel in enumerate(skeletons):
        same = 0
        while same < min(len(stack), len(skel)) and stack[same][0] == skel[same]:
            same += 1
        del stack[same:]
        for piece in skel[same:]:
            if piece not in tables:
                tables[piece] = _best([coded[c] for c in piece], letters, codes)
            m, so_far, f = len(piece), *(stack[-1][1:] if stack else (0, None))
            if stack:
                g = f.copy()
                reach, s = -(-(-(-8 * m // 3) + WIDTH - 1) // WIDTH), 1
                while reach > 0:  # the most of the blocks within reach
                    step = min(s, reach)
                    np.maximum(g[step:], g[:-step].copy(), out=g[step:])
                    reach, s = reach - step, 2 * s
                s = 1
                while 3 * WIDTH * s <= 8 * so_far:  # farther ones, less what the letters between cost
                    np.maximum(g[s:], g[:-s] - np.int16(3 * WIDTH * s), out=g[s:])
                    s *= 2
                g += np.maximum(tables[piece], np.int16(-3 * m))
            else:
                g = tables[piece]
            stack.append((piece, so_far + m, g))
        yield k, np.flatnonzero(stack[-1][2] >= 0)


def _common(masks: np.ndarray, m: np.ndarray, letters: np.ndarray, begins: np.ndarray, who: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``who, at, n, common`` of the runs of n letters before ``at`` that begin a word and have letters enough in common; bits in parallel."""
    words, shortest = masks.shape[2], low.min()
    v = np.full((words, len(who)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for n in range(1, int(high.max()) + 1):
        place = at - n
        c = letters[np.maximum(place, 0)]
        carry = None
        for w in range(words):
            u = v[w] & masks[who, c, w]
            total = v[w] + u
            over = total < u
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            v[w] = total | (v[w] - u)
        if n < shortest:
            continue
        ok = np.flatnonzero((place >= 0) & (n >= low) & (n <= high) & begins[np.maximum(place, 0)])
        if len(ok):
            common = np.bitwise_count(~v[:, ok]).sum(axis=0, dtype=np.int64)
            good = 2 * common >= share * (m[who[ok]] + n) - 1e-9
            ok = ok[good]
            if len(ok):
                yield who[ok], at[ok], np.full(len(ok), n), common[good]


def similar(skels: list[str], targets: list[int], words: list[str], own: int, threshold: float, most: int) -> Iterator[tuple[int, float, int, int, str]]:
    """``skeleton, score, first word, last word, span``: the runs that begin in the first ``own`` words, are similar enough and might be picked.

    ``targets`` are the longest skeletons of the phrases, which bound the length of a run. Of the runs of
    a skeleton in order of score and place those past the ``most``-th that lies farther than a run from the
    others are left out: each of these is picked or overlaps one that is, and no picked run overlaps two.
    """
    if not skels or not words:
        return
    coded = {c: k + 1 for k, c in enumerate(sorted(set("".join(skels))))}
    text = "".join(words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table, known = np.unique(points, return_inverse=True)
    letters = np.array([coded.get(chr(c), 0) for c in table], np.uint8 if len(coded) < 255 else np.int32)[known]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    past = np.cumsum(sizes)
    first_of = past - sizes
    begins = np.zeros(len(points) + 1, bool)
    begins[first_of[:own]] = True
    last_word = np.full(len(points) + 1, -1)
    last_word[past] = np.arange(len(words))
    word_at = np.zeros(len(points) + 1, np.int64)
    word_at[first_of] = np.arange(len(words))
    padded = np.concatenate([letters, np.zeros(-len(letters) % WIDTH, letters.dtype)])
    # A block's ends are those after its letters.
    of_block = np.minimum((past - 1) // WIDTH, len(padded) // WIDTH - 1)
    block_from = np.searchsorted(of_block, np.arange(len(padded) // WIDTH + 1))
    vocabulary = set(words)
    cut = {s: pieces(s, vocabulary) for s in set(skels)}
    order = sorted(range(len(skels)), key=lambda k: cut[skels[k]])
    shares = 8 * threshold >= 6  # the scores stand for a threshold of 0.75 at least
    who, at = [], []
    if shares:
        found = ends([cut[skels[k]] for k in order], coded, padded)
    else:
        found = ((k, np.arange(len(padded) // WIDTH)) for k in range(len(order)))
    for k, blocks in found:
        if len(blocks):
            a, n = block_from[blocks], block_from[blocks + 1] - block_from[blocks]
            e = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            who.append(np.full(len(e), order[k], np.int32))
            at.append(past[e])
    if not who:
        return
    who_all, at_all = np.concatenate(who), np.concatenate(at)
    m = np.fromiter(map(len, skels), np.int64, len(skels))
    t = np.array(targets, np.int64)
    least, ratio = np.ceil(np.maximum(0.5 * t, m * threshold / (2 - threshold)) - 1e-6), (2 - threshold) / threshold if threshold > 0 else np.inf
    greatest = np.floor(np.minimum(1.8 * t + 3, m * ratio) + 1e-6)
    by_length = np.argsort(m[who_all], kind="stable")
    hits: list[tuple[np.ndarray, ...]] = []
    done = 0
    while done < len(by_length):
        # Skeletons of one number of machine words together.
        size = -(-int(m[who_all[by_length[done]]]) // 64)
        upto = min(done + TOGETHER, int(np.searchsorted(m[who_all[by_length]], 64 * size, side="right")) if size > 1 or m.max() > 64 else len(by_length))
        part = by_length[done:upto]
        done = upto
        w, which = np.unique(who_all[part], return_inverse=True)
        masks = np.zeros((len(w), len(coded) + 1, size), np.uint64)
        for row, k in enumerate(w):
            for bit, c in enumerate(reversed(skels[k])):
                masks[row, coded[c], bit // 64] |= np.uint64(1 << (bit % 64))
        for a, e, n, common in _common(masks, m[w], padded, begins, which, at_all[part], least[who_all[part]], greatest[who_all[part]], threshold):
            hits.append((w[a], e, n, common))
    if not hits:
        return
    who_all, at_all, n_all, common_all = (np.concatenate(x) for x in zip(*hits))
    bound = 2.0 * common_all / (m[who_all] + n_all)
    best_first = np.lexsort((-at_all, -(at_all - n_all), -bound, who_all))
    scores: dict[tuple[str, str], float] = {}
    starts = np.flatnonzero(np.diff(who_all[best_first], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(best_first)]):
        rows = best_first[a:b]
        k = int(who_all[rows[0]])
        skel, far = skels[k], int(1.8 * targets[k] + 3)
        kept: list[tuple[float, int, int, str]] = []
        apart: list[tuple[int, int]] = []
        settled, level = 0, 0
        while level < len(rows) and len(apart) < most:
            now = bound[rows[level]]
            stop = level + int(np.searchsorted(-bound[rows[level:]], -now + 1e-12, side="right"))
            for x in rows[level:stop]:
                end, begin = int(at_all[x]), int(at_all[x] - n_all[x])
                span = text[begin:end]
                score = scores.get((skel, span))
                if score is None:
                    score = scores[skel, span] = difflib.SequenceMatcher(None, skel, span).ratio()
                if score >= threshold:
                    kept.append((score, begin, end, span))
            level = stop
            # Scores above the next bound are in their order for good.
            rest = bound[rows[level]] if level < len(rows) else -1.0
            kept[settled:] = sorted(kept[settled:], reverse=True)
            while settled < len(kept) and kept[settled][0] > rest + 1e-12 and len(apart) < most:
                _, begin, end, _ = kept[settled]
                if all(begin >= y + far or end + far <= x for x, y in apart):
                    apart.append((begin, end))
                settled += 1
        for score, begin, end, span in kept[:settled]:
            yield k, score, int(word_at[begin]), int(last_word[end]), span
