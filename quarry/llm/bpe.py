"""Exact BPE encoding by speculation and verification, vectorised over distinct words.

A vocabulary with word ends is read from a tokenizer file.  Texts are normalised and
cut at white space; each chunk that a worker has not met before is cut into words.
All new words are tokenised at once by greedy longest match over a trie (one array
step per byte), every adjacent pair of tokens is tested for compatibility with the merge
rules by walking both tokens' merge trees in step, and only words with a failing pair
are merged exactly, rule by rule.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

END = "</w>"
#: Chunks that one worker remembers; beyond this the memory starts anew.
MEMORY = 500_000
#: Characters of text that are worked on at once.
BLOCK_CHARS = 1_500_000
#: Letters, digits and signs that every library sees alike: no marks to compose, one lower
#: case, plain white space.  Texts with others are normalised by the tokenizers library.
UNUSUAL = "[^\\x00-\\x1b -~\u00a1-\u012f\u0131-\u017e\u2010-\u2027]"
SPACES = regex.compile(r"[^\S\x1c-\x1f]+")


def _byte_letters() -> list[str]:
    """Letter of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        if b in plain:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class WordBpe:
    """Encoder for one tokenizer file of the kind "BPE with word ends"."""

    def __init__(self, path: str, speculate: bool = True):
        self.speculate = speculate
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_or_break, self.unusual = regex.compile(pattern + "|\n"), regex.compile(UNUSUAL)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_text = [b""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token_text[i] = t.encode()
        self.letters = _byte_letters()
        self.byte_of = byte_of = {c: b for b, c in enumerate(self.letters)}
        self.library = Tokenizer.from_file(path)
        self.letter_id = np.array([vocab[c] for c in self.letters], np.int64)
        self.last_letter_id = np.array([vocab[c + END] for c in self.letters], np.int64)

        # merge trees: rank, children and the table of pairs
        none = np.int64(1) << 40
        self.form = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        keys = np.empty(len(merges), np.int64)
        self.merged = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            self.merged[r] = i
            self.form[i], self.left[i], self.right[i] = r, x, y
            keys[r] = x << 20 | y
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank, self.none = keys[order], order.astype(np.int64), none

        # trie over bytes, with 256 for the end of a word; only tokens that merging can make
        edges: dict[int, int] = {}
        token_at = [-1]
        for t, i in vocab.items():
            ends = t.endswith(END)
            try:
                path_ = [byte_of[c] for c in (t[: -len(END)] if ends else t)] + [256] * ends
            except KeyError:
                continue
            node = 0
            for b in path_:
                key = node << 9 | b
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(token_at)
                    token_at.append(-1)
                node = nxt
            token_at[node] = i
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.token_at = np.array(token_at, np.int64)
        self._forget()

    # -- single words -----------------------------------------------------------------

    def merge_exactly(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each word) by the merge rules alone: in every round each word
        merges its lowest-ranked pair, leftmost first among overlapping equals."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.letter_id[flat]
        sym[np.cumsum(length) - 1] = self.last_letter_id[flat[np.cumsum(length) - 1]]
        own = np.repeat(np.arange(n), length)
        rank = np.full(len(sym), self.none)  # of the pair that begins here
        rank[:-1] = np.where(own[1:] == own[:-1], self.ranks(sym[:-1], sym[1:]), self.none)
        done_sym, done_own = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            ended = lowest == self.none
            if ended.any():
                done_sym.append(sym[ended])
                done_own.append(own[ended])
                sym, own, rank, lowest = sym[~ended], own[~ended], rank[~ended], lowest[~ended]
                if not len(sym):
                    break
            hit = rank == lowest
            at = np.flatnonzero(hit)
            if (np.diff(at) == 1).any():
                # in a run of hits every second one, from the first
                begin = np.concatenate([[True], np.diff(at) > 1])
                run = at - at[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]
                at = at[run % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # only where another word begins or no pair is
            place = np.cumsum(keep) - 1
            at = place[at]
            sym, own, rank = sym[keep], own[keep], rank[keep]
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            change = np.flatnonzero(changed[:-1])
            rank[change] = np.where(own[change] == own[change + 1], self.ranks(sym[change], sym[change + 1]), self.none)
            rank[-1] = self.none
        sym, own = np.concatenate(done_sym), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        return sym[order], np.bincount(own, minlength=n)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the rule that joins each pair, or ``none``."""
        key = a << 20 | b
        p = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[p] == key, self.pair_rank[p], self.none)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair of tokens: does merging their joined text give just these two?

        Both tokens are undone step by step, the later-made one first.  The pair fails
        when a rule joins the two edge parts before either was merged into its parent
        (on the right also at the same rank, as the leftmost merge comes first).
        """
        ok = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        until_x, until_y = np.full(len(a), self.none), np.full(len(a), self.none)
        while len(at):
            r = self.ranks(x, y)
            joined = (r < until_x) & (r < self.none) & (r <= until_y)
            ok[at[joined]] = False
            fx, fy = self.form[x], self.form[y]
            go = ~joined & ((fx >= 0) | (fy >= 0))
            undo_x = fx > fy
            nx, ny = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            until_x, until_y = np.where(undo_x, fx, until_x), np.where(undo_x, until_y, fy)
            at, x, y, until_x, until_y = at[go], nx[go], ny[go], until_x[go], until_y[go]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words on end, number of ids of each word); no word is empty."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        out_ids, out_word, out_at = [], [], []
        word, pos, step = np.arange(n), np.zeros(n, np.int64), 0
        bad: set[int] = set()
        while len(word):
            node, best, best_end = np.zeros(len(word), np.int64), np.full(len(word), -1), np.zeros(len(word), np.int64)
            live, reach = np.arange(len(word)), pos.copy()
            while len(live):
                w = word[live]
                end = reach[live] == length[w]
                symbol = np.where(end, 256, flat[np.minimum(start[w] + reach[live], len(flat) - 1)])
                key = node[live] << 9 | symbol
                p = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                hit = self.edge_keys[p] == key
                live, end, to = live[hit], end[hit], self.edge_to[p[hit]]
                node[live] = to
                reach[live] += 1
                # a token without a word end can't close the word
                good = (self.token_at[to] >= 0) & (end | (reach[live] < length[word[live]]))
                best[live[good]], best_end[live[good]] = self.token_at[to[good]], reach[live[good]]
                live = live[~end]
            lost = best < 0
            bad.update(word[lost].tolist())
            word, best, best_end = word[~lost], best[~lost], best_end[~lost]
            out_ids.append(best)
            out_word.append(word)
            out_at.append(np.full(len(word), step))
            more = best_end <= length[word]
            # a token that ends with the word end has gone one past the last byte
            word, pos, step = word[more], best_end[more], step + 1
        ids, owner, at = map(np.concatenate, (out_ids, out_word, out_at))
        order = np.lexsort((at, owner))
        ids, owner = ids[order], owner[order]
        same = owner[1:] == owner[:-1]
        a, b = ids[:-1][same], ids[1:][same]
        pairs, where = np.unique(a << 20 | b, return_inverse=True)
        failing = ~self.compatible(pairs >> 20, pairs & ((1 << 20) - 1))[where]
        bad.update(np.unique(owner[:-1][same][failing]).tolist())
        counts = np.bincount(owner, minlength=n)
        if bad:
            redo = sorted(bad)
            redo_ids, redo_counts = self.merge_exactly([words[w] for w in redo])
            redo_owner = np.repeat(np.array(redo, np.int64), redo_counts)
            is_bad = np.zeros(n, bool)
            is_bad[redo] = True
            keep = ~is_bad[owner]
            owner, ids = np.concatenate([owner[keep], redo_owner]), np.concatenate([ids[keep], redo_ids])
            order = np.argsort(owner, kind="stable")
            owner, ids = owner[order], ids[order]
            counts = np.bincount(owner, minlength=n)
        return ids.astype(np.uint32), counts

    # -- texts ------------------------------------------------------------------------

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.ids_start, self.ids_len = np.empty(0, np.int64), np.empty(0, np.int64)

    def _split(self, chunks: list[str]) -> tuple[list[bytes], np.ndarray]:
        """(words of all chunks on end in UTF-8, words of each chunk)."""
        joined = "\n".join(chunks)
        if not self.unusual.search(joined):
            found = self.words_or_break.findall(joined)
            breaks = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
            per = np.diff(np.concatenate([[-1], breaks, [len(found)]])) - 1
            return [w.encode() for w in found if w != "\n"], per
        cut = [[bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(c)] for c in chunks]
        return [w for ws in cut for w in ws], np.fromiter(map(len, cut), np.int64, len(cut))

    def _learn(self, chunks: list[str]) -> None:
        if len(self.index) + len(chunks) > MEMORY:
            self._forget()
        every, per = self._split(chunks)
        words = list(set(every))
        place = dict(zip(words, range(len(words))))
        ids, counts = (self.encode_words if self.speculate else self.merge_exactly)(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
        begin = np.cumsum(counts) - counts
        which = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
        lens = counts[which] if len(which) else np.empty(0, np.int64)
        new = ids[_ragged(begin[which], lens)].astype(np.uint32) if len(which) else np.empty(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(per)])]
        base, known = len(self.ids), len(self.index)
        self.ids = np.concatenate([self.ids, new])
        self.ids_start = np.concatenate([self.ids_start, base + ends[:-1]])
        self.ids_len = np.concatenate([self.ids_len, np.diff(ends)])
        self.index.update(zip(chunks, range(known, known + len(chunks))))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, UNUSUAL)
        usual = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pc.invert(odd))))
        normal = self.library.normalizer.normalize_str
        rest = pa.array([[c for c in SPACES.split(normal(t)) if c] for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        per = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (usual, rest)]).astype(np.int64)
        coded = pa.chunked_array([usual.flatten(), rest.flatten()], pa.string()).combine_chunks().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.index) + len(distinct) > MEMORY and any(c not in self.index for c in distinct):
            self._forget()
        new = [c for c in distinct if c not in self.index]
        for a in range(0, len(new), MEMORY // 2):
            self._learn(new[a : a + MEMORY // 2])
        which = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        # back to the order of the texts
        place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        begin = np.cumsum(per) - per
        which, per = which[_ragged(begin[place], per[place])], per[place]
        lens = self.ids_len[which]
        ids = self.ids[_ragged(self.ids_start[which], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(per)])]
        return ids, ends

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, text i has ids[ends[i]:ends[i + 1]]); no text is null.

        Strings of special tokens in a text become their ids, as in the tokenizers library.
        """
        if not self.special or not pc.any(pc.match_substring_regex(texts, self.special_cut.pattern)).as_py():
            return self._plain(texts)
        pieces = [self.special_cut.split(t) for t in texts.to_pylist()]
        ids, ends = self._plain(pa.array([p for ps in pieces for p in ps if p not in self.special], pa.string()))
        out, sizes, at = [], [], 0
        for ps in pieces:
            total = 0
            for p in ps:
                if p in self.special:
                    part = np.array([self.special[p]], np.uint32)
                else:
                    part = ids[ends[at] : ends[at + 1]]
                    at += 1
                out.append(part)
                total += len(part)
            sizes.append(total)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ragged(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + lens[i] - 1 for all i on end."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.cumsum(lens) - lens
    return np.arange(total) + np.repeat(start - shift, lens)


_ENCODERS: dict[tuple[str, bool], WordBpe] = {}


def encoder(path: str, speculate: bool = True) -> WordBpe:
    """The worker's encoder for a vocabulary file; it outlives a task in a reused worker."""
    if (path, speculate) not in _ENCODERS:
        _ENCODERS[path, speculate] = WordBpe(path, speculate)
    return _ENCODERS[path, speculate]


def forget_encoders() -> None:
    """Drop the worker's encoders; the next use reads the vocabulary anew."""
    _ENCODERS.clear()


def encoded_blocks(batches, path: str, speculate: bool = True, id_column: str = "doc_id", text_column: str = "text"):
    """Yield (ids of rows as an Arrow array, ids, ends) for blocks of rows of Arrow batches; null texts are empty."""
    from .common import slices

    bpe = encoder(path, speculate)
    for batch in batches:
        texts = batch.column(text_column)
        keys = batch.column(id_column)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        for a, b in slices(pc.utf8_length(texts).to_pylist(), BLOCK_CHARS):
            ids, ends = bpe.encode_block(texts.slice(a, b - a))
            yield keys.slice(a, b - a), ids, ends


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
