"""The operators' kernels against plain versions, on random input."""

import random
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloakframe.llm import bwt_dedup, chat, common, decontam, licenses, packing, repetition, superminhash, wavelet
from cloakframe.llm.edit_counts import CountTree, cut
from cloakframe.llm.queries import word_tokenizer
from cloakframe.llm.tokens import WordEncoder, groups_of

from . import brute


@cache
def an_encoder(limit=10_000):
    return WordEncoder(word_tokenizer(), limit)


@cache
def a_tokenizer():
    return Tokenizer.from_file(word_tokenizer())


TEXT = st.text(alphabet=st.sampled_from(list("aAbé ñİ́'s.,!?09#%)\"<|>\n\t\x1c\xa0中×")), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    enc, plain = an_encoder(40), a_tokenizer()
    texts = [*texts, None, "x <|endoftext|> <|ENDOFTEXT|> Y.", "don't we'll 3's", "word it's é İ naïveté", "word.### it's) é%%% İ, naïveté\" ×. word### word"]
    ids, lens = enc.encode(texts)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and lens.tolist() == list(map(len, want))
    assert enc.counts(texts).tolist() == list(map(len, want))
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["É cut", None, *texts], kind).slice(2)
        ids, lens = enc.encode(column)
        assert ids.tolist() == [i for w in want for i in w] and lens.tolist() == list(map(len, want))
        assert [b - a for a, b in groups_of(column, 5)] and sum(b - a for a, b in groups_of(column, 5)) == len(texts)
    heads = [t[: len(t) // 2] if t else t for t in texts]
    for text, head, n in zip(texts, heads, enc.encode_with_heads(texts, heads)[2], strict=True):
        words = (text or "").encode().split()[: len((head or "").encode().split())]
        assert n == sum(len(plain.encode(w.decode(), add_special_tokens=False).ids) for w in words)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_encoder_with_a_tokenizer_that_keeps_white_space(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    enc, plain = WordEncoder(path), Tokenizer.from_file(path)
    texts = ["Hello  world.\n\tfoo bar", None, "", " x ", "word.### it's"]
    ids, lens = enc.encode(texts)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not enc.by_word and ids.tolist() == [i for w in want for i in w] and lens.tolist() == enc.counts(texts).tolist() == list(map(len, want))
    assert WordEncoder(word_tokenizer()).by_word and WordEncoder(word_tokenizer()).by_mark


def settled(tree, enc):
    """The tree after an update; how many characters were encoded for it."""
    parts = tree.pending()
    tree.settle(enc.counts(parts).tolist())
    return sum(map(len, parts))


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.lists(st.tuples(st.integers(-2, 90), st.integers(-1, 40), TEXT | st.text("ab \n", min_size=65, max_size=90)), max_size=4), max_size=3))
def test_edits(text, updates):
    enc = an_encoder()
    parts = cut(text, 8)
    tree = CountTree.planted(parts, enc.counts(parts or [""]).tolist(), 8)
    for edits in updates:
        for a, n, new in edits:
            tree.replace(a, n, new)
            a, n = min(max(a, 0), len(text)), max(n, 0)
            text = text[:a] + new + text[a + n :]
            assert tree.text() == text
        settled(tree, enc)
        assert tree.total() == len(enc.tokenizer.encode(text, add_special_tokens=False).ids)
        fresh = CountTree.planted(tree.leaves, enc.counts(tree.leaves).tolist(), 8)
        assert (tree.chars, tree.tokens) == (fresh.chars, fresh.tokens)


def test_edits_encode_what_they_touch():
    enc, asked = WordEncoder(word_tokenizer()), []
    text = " ".join(f"word{i}" for i in range(20_000))
    parts = cut(text, 64)
    tree = CountTree.planted(parts, enc.counts(parts).tolist(), 64)
    for pos in (0, 3, 70_000, 70_010, len(text)):
        tree.replace(pos, 2, "zz")
        asked.append(settled(tree, enc))
    assert max(asked) < 3 * 80 and settled(tree, enc) == 0
    tree.replace(5, 0, "one edit " * 100)
    assert settled(tree, enc) < 1100 and tree.total() == len(enc.tokenizer.encode(tree.text(), add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 3, 8, 10]))
def test_repeats(docs, size):
    covered, longest = repetition.repeats(np.array([x for d in docs for x in d], np.uint64), np.array([len(d) for d in docs]), size)
    for d, c, n in zip(docs, covered, longest, strict=True):
        assert c == brute.repeat_words(d, size)
        want = brute.longest_repeat(d)
        assert n == (want if want >= size else 0)


@pytest.mark.parametrize("n", [0, 1, 8, 511, 512, 513, 4000])
def test_wavelet(n):
    rng = np.random.default_rng(n)
    for top in (1, 3, 70_000):
        ids = rng.integers(0, top, n)
        x = wavelet.Shard(wavelet.build(ids, [5, None], np.array([n // 2, n])))
        assert (x.decode() == ids).all() and x.doc_ids == [5, None] and x.ends.tolist() == [n // 2, n]
        assert (x.access(np.arange(n)) == ids).all()
        for i in range(0, n, max(1, n // 17)):
            s = int(ids[i])
            assert x.rank(s, i) == (ids[:i] == s).sum()
            assert x.count(s, i // 2, i) == (ids[i // 2 : i] == s).sum()
            assert x.select(s, [x.rank(s, i)]) == [i]
            assert (np.concatenate(list(x.occurrences(s, 7))) == np.flatnonzero(ids == s)).all()
            assert (x.counts(s, np.arange(n + 1)) == np.concatenate([[0], np.cumsum(ids == s)])).all()
        assert x.count(1 << 20) == 0 and list(x.occurrences(1 << 20)) == []
        for bad in ([n], [-1]):
            with pytest.raises(IndexError):
                x.access(bad)


def test_wavelet_reads_only_the_frames_it_needs():
    ids = np.random.default_rng(1).integers(0, 40_000, 3 << 20)
    image = wavelet.build(ids, [1], np.array([len(ids)]))
    x = wavelet.Shard(image)
    frames = sum(len(p) - 1 for p in x.places)
    assert x.access([1_234_567])[0] == ids[1_234_567] and x.n_frames_read <= 2 * x.planes < frames / 2
    x = wavelet.Shard(image)
    assert x.count(77) == (ids == 77).sum() and x.n_frames_read <= 2 * x.planes
    assert not hasattr(x, "raw") and len(x.frames) == x.n_frames_read


def test_packing_limits():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t = rng.integers(1, rng.choice([50, 200]), rng.integers(1, 60))
        q = np.minimum(t, rng.integers(0, 50, len(t)))
        limits = packing.Limits(64, int(rng.choice([2, 5, 100])), int(rng.choice([20, 64])))
        got = {}
        for own in packing.fill(t, q, limits):
            assert sum(p[2] for p in own) <= 64 and len(own) <= limits.segments
            assert sum(max(0, s + n - max(s, t[i] - q[i])) for i, s, n in own) <= limits.loss_tokens
            for i, s, n in own:
                got.setdefault(i, []).append((s, n))
        for i, n in enumerate(t):
            at = 0
            for s, k in sorted(got[i]):
                assert s == at
                at += k
            assert at == n


def by_size(t, limits):
    """Bins of items by size alone: the largest that fits, each time."""
    left, bins = sorted(range(len(t)), key=lambda i: -t[i]), []
    while left:
        room, own = limits.tokens, []
        while (k := next((i for i in left if t[i] <= room), None)) is not None:
            own.append(k)
            left.remove(k)
            room -= t[k]
        bins.append(own)
    return bins


def test_packing_weighs_all_dimensions():
    """The pieces that a bin takes depend on their loss, not on their size alone, and the product fills bins with scarce loss better."""
    rng = np.random.default_rng(5)
    t = rng.integers(1, 40, 400)
    q = np.where(rng.random(400) < 0.5, t, t // 4)
    limits = packing.Limits(100, 50, 70)
    got = packing.fill(t, q, limits)
    assert [sorted(i for i, _, n in own if n == t[i]) for own in got[:10]] != [sorted(b) for b in by_size(t, limits)[:10]]
    full = [(sum(p[2] for p in own), sum(max(0, s + n - max(s, t[i] - q[i])) for i, s, n in own)) for own in got[:-1]]
    assert all(a == 100 or b == 70 for a, b in full) and sum(a == 100 for a, b in full) > 0.8 * len(full)


def test_superminhash_estimates_and_order():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.85):
        n, k = 400, int(400 * 2 * share / (1 + share))
        rows = []
        for _ in range(30):
            both = rng.integers(0, 1 << 62, k).astype(np.uint64)
            rows += [np.concatenate([both, rng.integers(0, 1 << 62, n - k).astype(np.uint64)]) for _ in range(2)]
        sig = superminhash.signatures(np.concatenate(rows), np.full(len(rows), n), 100)
        alone = superminhash.signatures(rows[0][::-1].copy(), np.array([n]), 100)
        assert (alone[0] == sig[0]).all()
        assert abs(np.mean(sig[::2] == sig[1::2]) - k / (2 * n - k)) < 0.03
    few = superminhash.signatures(np.array([7], np.uint64), np.array([0, 1, 0]), 16)
    assert len(set((few[1] >> np.uint64(56)).tolist())) == 16 and (few[0] == few[2]).all()


@pytest.mark.parametrize("share", [0.85, 0.87, 0.9, 0.95])
def test_recall_of_the_bands(share):
    """Of 3,000 planted pairs of a similarity, all but those of the stated chance share a bucket: at 0.85, 0.00001."""
    rng = np.random.default_rng(6)
    n, pairs = 200, 3000
    k = int(np.ceil(2 * n * share / (1 + share)))
    both, rest = rng.integers(0, 1 << 62, (pairs, k)), rng.integers(0, 1 << 62, (pairs, 2, n - k))
    rows = np.concatenate([np.repeat(both[:, None], 2, 1), rest], 2).reshape(2 * pairs, n).astype(np.uint64)
    keys = superminhash.band_keys(superminhash.signatures(rows.ravel(), np.full(2 * pairs, n), 100), 20, 5)
    assert (keys[::2] == keys[1::2]).any(1).sum() >= pairs - 1


def test_words_and_buffers():
    texts = ["Hello  world\tfoo\n", None, "", " ", "é b é", "x" * 10]
    data, offsets = common.text_buffers(pa.array(["cut", *texts]).slice(1))
    starts, ends, per = common.word_spans(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in brute.WS.findall(t or "")]
    h = common.word_hashes(data, starts, ends)
    assert h[3] == h[5] and len(set(h.tolist())) == len(h) - 1 and per.tolist() == [3, 0, 0, 0, 3, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=12).map(str.encode), min_size=1, max_size=8), st.sampled_from([0, 1 << 20]), st.sampled_from([1, 2, 5, 1000]), st.sampled_from([3, 100]))
def test_collection(strings, most, window, cap):
    """Order and common prefixes of all suffixes, in memory and in files, with windows of any size."""
    made = bwt_dedup.Collection(strings, cap, most, window)
    got = [(int(i), int(j), int(c)) for x in made.entries() for i, j, c in zip(*x, strict=True)]
    want = sorted((strings[i][j:], i, j) for i in range(len(strings)) for j in range(len(strings[i]) + 1))
    assert [(i, j) for i, j, _ in got] == [(i, j) for _, i, j in want]

    def common(x, y):
        return next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

    assert [c for _, _, c in got] == [min(cap, common(x[0], y[0])) for x, y in zip([(b"",)] + want, want, strict=False)]
    assert (most == 0) == any(r.file for r in made.runs)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=14).map(str.encode), min_size=1, max_size=8), st.sampled_from([1, 3, 1000]), st.sampled_from([2, 3, 5]))
def test_later_windows(strings, window, size):
    seen, want = set(), set()
    for i, x in enumerate(strings):
        for j in range(len(x) - size + 1):
            if x[j : j + size] in seen:
                want.add((i, j))
            seen.add(x[j : j + size])
    keys = np.stack([np.arange(len(strings)), np.zeros(len(strings), np.int64)], 1)
    sid, start = bwt_dedup.later_windows(strings, keys, size, 0, window)
    assert set(zip(sid.tolist(), start.tolist(), strict=True)) == want and len(sid) == len(want)


def test_anchors_cover_each_window_once():
    rng = random.Random(3)
    for _ in range(25):
        docs = [bytes(rng.choice(b"ab" if rng.random() < 0.4 else b"abcdefgh ") for _ in range(rng.choice([0, 99, 100, 101, 500]))) for _ in range(4)]
        docs += [docs[0][:150] + docs[2][-200:] + docs[0][:150], b"x" * 250]
        data, off = np.frombuffer(b"".join(docs), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        at_window, seen = {}, {}
        for _, a, lo, hi in zip(*bwt_dedup.anchored(data, off, 100), strict=True):
            for i in range(lo, hi + 1):
                assert i not in at_window
                at_window[i] = a
                assert seen.setdefault(data[i : i + 100].tobytes(), a - i) == a - i
        assert set(at_window) == {i for a, b in zip(off, off[1:], strict=False) for i in range(a, b - 99)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "a\nb\\#<"]), st.text(alphabet="\\#</turn>\n xé", max_size=30)), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    text = "".join(chat.turn_text(r, t)[0] for r, t in turns)
    assert chat.parse(text) == turns
    full, a, b = chat.turn_text(*turns[0])
    assert chat.unescape(full[a:b]) == turns[0][1]


def planned(tokens, has_system, budget, history):
    """Windows by prefix sums over the whole list: (window, number, repeated) of each place."""
    sums, out, at, w = np.concatenate([[0], np.cumsum(tokens)]), [], 0, 0
    while at < len(tokens):
        base = tokens[0] if has_system and at else 0
        back = at
        while back > has_system and sums[at] - sums[back - 1] <= history and sums[at + 1] - sums[back - 1] + base <= budget:
            back -= 1
        past = at + 1
        while past < len(tokens) and sums[past + 1] - sums[back] + base <= budget:
            past += 1
        out += [(w, 0, True)] * bool(has_system and at) + [(w, i, i < at) for i in range(back, past)]
        at, w = past, w + 1
    return out


def test_chat_windows_hold_the_budget():
    rng = random.Random(4)
    for _ in range(300):
        tokens = [rng.randint(1, rng.choice([60, 130])) for _ in range(rng.randint(1, 30))]
        system = rng.random() < 0.5
        planner, got = chat.Planner(100, 30), []
        for i, n in enumerate(tokens):
            got += planner.add(i, n, system and not i)
            assert sum(n for _, n, _ in planner.recent) <= 30
        assert [(w, i, again) for w, i, again, _ in got] == planned(tokens, system, 100, 30) and all(i == t for _, i, _, t in got)
        assert [i for _, i, again, _ in got if not again] == list(range(len(tokens)))
        for w in {x[0] for x in got}:
            own = [(i, again) for v, i, again, _ in got if v == w]
            assert sum(tokens[i] for i, _ in own) <= 100 or sum(not again for _, again in own) == 1


ALL = licenses.templates_of(licenses.TEMPLATES)
WORDS = {}
for _t in ALL:
    WORDS.setdefault(_t.name, _t.words)


def named(words):
    """name, coverage, first and past of all notices in words."""
    return [(n, c, a, b) for n, _, c, a, b in licenses.matches(words, ALL, 0.8)]


def test_alignment():
    t = WORDS["MIT"]
    changed = [w for i, w in enumerate(t) if i % 9] + ["tail"]
    pairs = licenses.align(changed, t)
    assert all(changed[i] == t[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) >= 0.85 * len(t)
    found = licenses.matches(["x"] * 500 + changed + ["the", "of"] * 50 + t, licenses.templates_of({"MIT": licenses.TEMPLATES["MIT"]}), 0.8)
    assert [f[0] for f in found] == ["MIT", "MIT"]
    assert named("the license of the work is under version".split()) == []


@pytest.mark.parametrize("name", ["MIT-notice", "CC-BY-NC-4.0-notice", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Zlib"])
@pytest.mark.parametrize("gap", [0, 1, 7, 150])
def test_notices_near_each_other(name, gap):
    t, words, want = WORDS[name], [], []
    for c in range(5):
        words += [f"x{c}{i}" for i in range(gap)]
        want.append((name, 1.0, len(words), len(words) + len(t)))
        words += t
    assert named(words) == want


@pytest.mark.parametrize("t", ALL, ids=lambda t: f"{t.name}-{len(t.words)}")
def test_each_notice_has_its_own_name(t):
    assert named(["x", *t.words, "y"]) == [(t.name, 1.0, 1, 1 + len(t.words))]


def test_changed_notices_near_each_other():
    """Copies with words changed, added and left out, of several licences, one after the other."""
    rng = random.Random(3)
    for name in ("MIT", "BSD-2-Clause", "ISC", "Apache-2.0-header", "GPL-3.0-or-later"):
        words, want = [], []
        keys = {j for t in ALL if t.name in (name, "MIT") and t.words == WORDS[t.name] for a, n in t.phrases for j in range(a, a + n)}
        for c in range(30):
            kind = name if c % 3 else "MIT"
            start = len(words)
            for i, w in enumerate(WORDS[kind]):
                words += [[w], [w], [w, f"new{c}{i}"], [f"other{c}{i}"], []][rng.randrange(5) if rng.random() < 0.1 and 0 < i < len(WORDS[kind]) - 1 and i not in keys and i + 1 not in keys else 0]
            want.append((kind, start, len(words)))
        found = named(words)
        assert [f[0] for f in found] == [w[0] for w in want]
        assert all(abs(f[2] - w[1]) + abs(f[3] - w[2]) <= 0.15 * len(WORDS[w[0]]) for f, w in zip(found, want, strict=True))


def test_notice_with_words_added_on_the_left():
    words = "y copyright c 2019 2021 john smith jane doe and the other contributors all rights reserved z".split()
    t = licenses.templates_of({"t": "copyright by contributors all rights reserved"})
    assert licenses.matches(words, t, 0.8) == [("t", 5, 5 / 6, 1, 16)]


@pytest.mark.parametrize(("text", "want"), [
    ("Released under the BSD License.", ["BSD-notice"]),
    ("It is released under the Apache License.", ["Apache-notice"]),
    ("Licensed under the Apache License, Version 1.1.", ["Apache-notice"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-notice"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-notice"]),
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0-notice"]),
    ("Licensed under CC BY-NC-ND 4.0.", ["CC-BY-NC-ND-4.0-notice"]),
    ("Licensed under CC BY-XY 4.0.", []),
    ("Released under the WTF License.", []),
    ("Released under the Foo License. The MIT Press.", []),
    ("Copyright 2020. All rights reserved.", ["all-rights-reserved"]),
    ("This software is released under the MIT License and the BSD License", ["MIT-notice"]),
    ("under the MIT License", ["MIT-notice"]),
    ("the MIT License", []),
])
def test_near_misses(text, want):
    assert [n for n, *_ in named(licenses.words_of(text))] == want


def test_against_a_brute_force_aligner():
    """Altered notices in prose. What is found has its phrases and isn't better covered than the longest common subsequence; what that covers to 0.9 with the phrases untouched is found, by its name."""
    rng = random.Random(8)
    prose = ["the", "of", "license", "software", "under", "version", "and", "is", "to", "this", "copyright", "a1", "b2", "c3"]
    missed = 0
    short = [t for t in ALL if len(t.words) < 90]
    for _ in range(400):
        t = rng.choice(short)
        keys = {j for a, n in t.phrases for j in range(a, a + n)}
        rate = rng.choice([0.0, 0.03, 0.08, 0.2])
        body = []
        for j, w in enumerate(t.words):
            kind = rng.random()
            if kind < rate and j not in keys:
                body += rng.choice([[], ["zz"], [w, "zz"]])
            else:
                body.append(w)
        words = [rng.choice(prose) for _ in range(rng.randint(0, 30))] + body + [rng.choice(prose) for _ in range(rng.randint(0, 30))]
        found = named(words)
        by = {x.name: [y for y in ALL if y.name == x.name] for x in ALL}
        for name, c, a, b in found:
            own = " ".join(words[a:b])
            assert any(brute.lcs(words[a:b], y.words) >= round(c * len(y.words)) >= 0.8 * len(y.words) and all(" ".join(y.words[p : p + n]) in own for p, n in y.phrases) for y in by[name])
        if brute.lcs(body, t.words) >= 0.9 * len(t.words):
            missed += t.name not in [f[0] for f in found]
    assert missed == 0


def test_scan_offsets():
    machine = decontam.automaton([(1, "a b c d e f g h i j k"), (2, "Q r")])
    runs, items = decontam.scan(decontam.normalised("x A-b c d e f g h i J k, q R"), machine)
    assert runs == [(1, 12), (12, 14)] or runs == [(1, 14)]
    assert items == {1, 2}
    assert decontam.automaton([(1, None), (2, "!!")]) is None
