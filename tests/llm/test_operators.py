"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random
import textwrap
import uuid

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from conftest import SF

from codeloom.llm import classifier, common, components, decontaminate, licenses, line_dedup, near_dedup, packing, quality, queries, simhash, substring_dedup, token_counts, token_output, tokenizer

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "o", "en", "ur"]) for _ in range(n))


def table(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", ["op2_decontamination", "op5_quality_rules", "op7_substring_dedup"])
def test_sql(same_rows, name):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


# 1, 3, 9: tokens

ODD = ["", " ", "a", "  two  spaces ", "tabs\t\tand\n\n\nlines ", "Ünïcödé ßtraße 你好世界 🙂🙂", "don't we'll they're I'd", "x" * 300, "1234567890 12.5%", " hard  space  em", "''re 're 've", "<|endoftext|> !!!???"]


@pytest.fixture(scope="module")
def encoding() -> tiktoken.Encoding:
    return tokenizer.encoding()


def test_token_ids_are_those_of_the_encoder(encoding, texts):
    sample = [*ODD, *list(texts.values())[:60]]
    ids, bounds = tokenizer.token_ids(pa.array(sample))
    for text, a, b in zip(sample, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == encoding.encode_ordinary(text)
    assert tokenizer.token_counts(pa.array(sample)).tolist() == np.diff(bounds).tolist()


def test_sequences_round_trip(spark, docs, texts, encoding):
    folder = f"{common.shared_dir(spark)}/seq-{uuid.uuid4().hex}"
    rows = token_output.write_sequences(docs, folder, seq_len=128, per_batch=8).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    files = {r["file"]: token_output.Sequences(r["file"]) for r in rows if r["file"]}
    real = 0
    for r in rows:
        want = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        if want:
            assert files[r["file"]].document(r["first_sequence"], r["first_offset"], r["n_tokens"]) == want
            real += len(want) + 1
    masks = sum(int(s[i][1].sum()) for s in files.values() for i in range(len(s)))
    assert masks == real
    ids, mask = next(iter(files.values()))[0]
    assert len(ids) == len(mask) == 128 and not ids.flags.owndata and not mask.flags.owndata
    assert {r["file"] for r in token_output.files_of(spark, folder).collect()} == set(files)


def test_prefix_counts(spark, encoding):
    rows = {r["doc_id"]: r for r in token_counts.prefix_counts(table(spark, list(enumerate(ODD))), budgets=(3,)).collect()}
    for i, text in enumerate(ODD):
        exact = [len(encoding.encode_ordinary(text[:p])) for p in range(len(text) + 1)]
        packed = bytes(rows[i]["prefix_table"])
        assert token_counts.unpack(packed).tolist() == exact
        assert rows[i]["n_tokens"] == exact[-1] and rows[i]["n_chars"] == len(text)
        assert rows[i]["fit_3"] == token_counts.truncate_at(packed, 3) == max(p for p, n in enumerate(exact) if n <= 3)


def test_packing_covers_every_token(docs, texts, encoding):
    rows = packing.pack(docs, capacity=256, block=32).collect()
    spans: dict = {}
    bins: dict = {}
    for r in rows:
        if r["bin"] is not None:
            spans.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
            bins.setdefault(r["bin"], []).append(r)
    for doc, text in texts.items():
        at = 0
        for first, n in sorted(spans.get(doc, [])):
            assert first == at
            at += n
        assert at == len(encoding.encode_ordinary(text))
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert at == members[0]["bin_used"] <= 256


def _least_bins(sizes: list[int], capacity: int) -> int:
    best = len(sizes)

    def go(i: int, rooms: tuple[int, ...]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                left = list(rooms)
                left.remove(room)
                go(i + 1, tuple(sorted([*left, room - sizes[i]])))
        go(i + 1, tuple(sorted([*rooms, capacity - sizes[i]])))

    go(0, ())
    return best


def test_fillings_are_the_undominated_ones():
    """Against all subsets: a set is dominated if some of its members give way to one larger piece that then fits."""
    rng = random.Random(9)
    for _ in range(80):
        pieces = sorted((rng.randint(1, 9) for _ in range(rng.randint(1, 7))), reverse=True)
        room = rng.randint(1, 16)
        values = sorted(set(pieces), reverse=True)
        counts = [pieces.count(v) for v in values]
        want = set()
        for n in range(len(pieces) + 1):
            for at in itertools.combinations(range(len(pieces)), n):
                taken = [pieces[i] for i in at]
                left = room - sum(taken)
                if left < 0:
                    continue
                free = list(pieces)
                for v in taken:
                    free.remove(v)
                better = any(v <= left for v in free) or any(x <= v <= x + left and not (m == 1 and x == v) for v in free for m in range(1, n + 1) for x in (sum(c) for c in itertools.combinations(taken, m)))
                if not better:
                    want.add(tuple(sorted(taken, reverse=True)))
        got = list(packing.fillings(values, counts, room, room))
        assert len(got) == len(set(got)) and {tuple(sorted(g, reverse=True)) for g in got} == want, (pieces, room)
    assert list(packing.fillings([6, 3], [1, 2], 6, 0)) == [(6,)]


def test_bin_completion_is_optimal_on_small_instances():
    rng = random.Random(5)
    better = 0
    for _ in range(60):
        sizes = sorted((rng.randint(8, 60) for _ in range(rng.randint(1, 10))), reverse=True)
        got = packing.complete(sizes, 100, nodes=5000)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in got)
        assert len(got) == _least_bins(sizes, 100)
        better += len(got) < len(packing.best_fit(sizes, 100))
    assert packing.complete([], 10) == []
    hard = sorted([42, 41, 40, 38, 37, 36, 35, 31], reverse=True)  # best fit needs more than the least
    assert len(packing.complete(hard, 150)) == _least_bins(hard, 150)


# 2: decontamination


def _grams(text: str, n: int) -> list[tuple[str, ...]]:
    words = [w for w in ("".join(c for c in x if c.isalnum()) for x in text.lower().split()) if w]
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([tuple(words)] if words else [])


def test_decontamination(spark):
    item = prose(1, 20)
    w = item.split()
    rows = [
        (1, f"{prose(2, 30)} {item.upper()}! {prose(3, 30)}"),
        (2, prose(4, 60)),
        (3, item),
        (4, f"{prose(5, 9)}\n{' '.join(w[:9])} CHANGED {' '.join(w[10:])} {prose(6, 9)}"),
        (5, " ".join(w[:7])),
        (6, None),
        (None, f"{prose(7, 5)} {item}"),
    ]
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "!!!")], "item_id bigint, text string")
    docs = table(spark, rows)
    for set_bytes in (1 << 26, 300):
        found = sorted((str(r["doc_id"]), r["item_id"], r["first_word"], r["n_words"]) for r in decontaminate.find_contamination(docs, bench, set_bytes=set_bytes).collect())
        assert found == [("1", 0, 30, 20), ("3", 0, 0, 20), ("4", 0, 9, 20), ("None", 0, 5, 20)]
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert 3 not in cleaned and cleaned[2] == rows[1][1] and cleaned[5] == rows[4][1] and cleaned[6] is None
    assert cleaned[1] == f"{prose(2, 30)} {prose(3, 30)}"
    known = set(_grams(item, 8))
    assert not any(known & set(_grams(t, 8)) for t in cleaned.values() if t)
    gone = decontaminate.decontaminate(docs, bench, remove="documents")
    assert sorted(str(r["doc_id"]) for r in gone.collect()) == ["2", "5", "6"]


def test_decontamination_in_several_sets(spark):
    items = [(k, prose(300 + k, 30)) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(k, t) for k, t in items] + [(20 + k, f"{prose(320 + k, 12)} {t} {prose(340 + k, 12)}") for k, t in items]
    docs = table(spark, [*rows, rows[3], rows[15], rows[15]])

    def both(run):
        return [sorted(map(tuple, run(size).collect())) for size in (1 << 26, 3_000)]

    one, many = both(lambda size: decontaminate.decontaminate(docs, bench, set_bytes=size))
    assert one == many and min(r[0] for r in one) == 20 and len(one) == 14
    assert all(r[1] == f"{prose(300 + r[0], 12)} {prose(320 + r[0], 12)}" for r in one)
    one, many = both(lambda size: decontaminate.find_contamination(docs, bench, set_bytes=size))
    assert one == many and len(one) == 27


# 4: near duplicates


def _sets(texts: list[str]) -> list[set]:
    f, bounds, _ = near_dedup.features(pa.array(texts))
    return [set(f[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]


def test_small_world_recall_against_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (1500, near_dedup.SIG_WORDS), dtype=np.uint64)
    copies = base[:500].copy()
    for i in range(len(copies)):
        for bit in rng.integers(0, 64 * near_dedup.SIG_WORDS, rng.integers(0, 60)):
            copies[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    sigs = np.concatenate([base, copies])
    world = near_dedup.SmallWorld(sigs)
    q, n = world.within(sigs, world.audited_beam())
    found = {(a, b) for a, b in zip(q.tolist(), n.tolist()) if a != b}
    true = {(i, int(j)) for i, hit in enumerate(world.exact(sigs)) for j in hit if i != j}
    assert len(true) >= 1000 and found <= true and len(found) >= 0.9 * len(true)


def test_near_duplicate_groups_against_brute_force(spark, docs, texts):
    ids = sorted(texts)
    sets = dict(zip(ids, _sets([texts[i] for i in ids])))
    f, bounds, node = near_dedup.features(pa.array([texts[i] for i in ids]))
    sig = simhash.signatures(f, bounds, near_dedup.SIG_WORDS)
    true = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(ids), 2):
        if sets[a] and (node[i] == node[j] or (simhash.distance(sig[i], sig[j]) <= near_dedup.RADIUS and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= near_dedup.SIMILARITY)):
            true.add((a, b))
    rows = near_dedup.near_duplicate_groups(docs).collect()
    group = {r["doc_id"]: r["group_id"] for r in rows}
    assert len(true) > 10
    assert sum(a in group and group.get(a) == group.get(b) for a, b in true) >= 0.9 * len(true)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in true:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(d) == find(g) for d, g in group.items())  # nothing is joined that should not be
    kept = [r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).select("doc_id").collect()]
    lost = {r["doc_id"] for r in rows if not r["keep"]}
    assert sorted(kept) == sorted(set(ids) - lost)


def _flipped(rng, sig, most):
    out = sig.copy()
    for bit in rng.choice(64 * len(sig), rng.integers(0, most + 1), replace=False):
        out[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return out


def _nodes(spark, sigs):
    return spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sigs)], "node bigint, sig binary")


def test_a_large_cluster_of_near_copies_is_not_written_as_all_its_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, near_dedup.SIG_WORDS, dtype=np.uint64)
    rows = near_dedup.candidate_pairs(_nodes(spark, [_flipped(rng, base, 30) for _ in range(700)]), shards=3).collect()
    pairs = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert len(pairs) <= 700 * 2 * near_dedup.PLENTY < 700 * 699 / 2 / 5
    assert {r["a"] for r in rows if r["a"] == r["b"]} == set(range(700))
    _, root = components.union(*np.array(pairs).T)
    assert len(root) == 700 and not root.any()


@pytest.mark.parametrize("dense_pass", [10, 10_000])
def test_other_pairs_of_dense_nodes_are_all_found(spark, dense_pass):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, near_dedup.SIG_WORDS, dtype=np.uint64)
    loose = [_flipped(rng, base, 60) for _ in range(60)]
    sigs = np.array([*loose, *(_flipped(rng, loose[0], 20) for _ in range(40)), *rng.integers(0, 1 << 63, (50, near_dedup.SIG_WORDS), dtype=np.uint64)])
    dense = [*range(0, 30), *range(60, 90)]
    root = {k: k % 4 for k in range(80)}
    met = {(0, 1), (2, 3)}
    got = near_dedup.other_pairs(
        _nodes(spark, sigs),
        spark.createDataFrame([*met, *((k, k) for k in dense)], "a bigint, b bigint"),
        spark.createDataFrame([(k, r) for k, r in root.items()], "node bigint, root bigint"),
        dense_pass=dense_pass,
    ).collect()
    near = simhash.distance(sigs[:, None], sigs[None, :]) <= near_dedup.RADIUS
    want = {(i, j) for i, j in itertools.combinations(range(len(sigs)), 2) if near[i, j] and (i in dense or j in dense) and root.get(i, i + 1000) != root.get(j, j + 1000)} - met
    assert len(want) > 500 and sorted(map(tuple, got)) == sorted(want)


# 5: quality rules


def test_quality_rules_prefer_the_target(spark):
    rows = [(i, prose(i, 80)) for i in range(40)] + [(100 + i, " ".join(f"zz{random.Random(i * 99 + k).randint(0, 30)}" for k in range(80))) for i in range(20)] + [(200, None), (201, " \n ")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 0), (None, 1, 0), (101, None, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_documents(table(spark, rows), labels).collect()}
    assert min(got[i]["score"] for i in range(40)) > max(got[100 + i]["score"] for i in range(20))
    assert sum(got[i]["keep"] for i in range(40)) >= 38 and not any(got[100 + i]["keep"] for i in range(20))
    assert got[200]["score"] is None and not got[200]["keep"] and not got[201]["keep"]
    none = quality.score_documents(table(spark, rows[:3]), labels.limit(0)).collect()
    assert all(r["keep"] for r in none)


# 6: licenses


def test_license_scan(spark):
    mit = licenses.TEMPLATES[0][1][3]
    rows = [
        (1, f"{prose(1, 20)}\nReleased under the MIT License.\n{prose(2, 20)}"),
        (2, f"Copyright (c) 2020 A. Author\n{mit}"),
        (3, "Licensed under CC BY-SA 4.0."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, prose(3, 50)),
        (6, "Copyright 2001 Somebody"),
        (7, None),
        (8, mit.replace("merge, publish", "merge, print")),
    ]
    got = {}
    for r in licenses.scan(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["exact"]))
    assert got == {1: [("MIT", True)], 2: [("MIT", True)], 3: [("CC-BY-SA-4.0", True)], 4: [("CC-BY-NC-4.0", True)], 6: [(None, False)], 8: [("MIT", False)]}
    for name, wordings in licenses.TEMPLATES:
        for wording in wordings:
            assert licenses.identify(wording)[0] == name


def _licenses(text: str) -> list:
    return sorted({f[2][0] for f in licenses.notices(text)})


def test_license_in_long_lines():
    """A notice within a line of any length: the whole compresses worse with a short dictionary than without."""
    for n in (500, 1000, 20_000):
        for name, wordings in licenses.TEMPLATES:
            for wording in (wordings[0], wordings[-1]):
                assert _licenses(f"{prose(n, n // 2)} {wording} {prose(n + 1, n // 2)}") == [name]


def _by_brute_force(text: str) -> set[str]:
    """Licenses of the wordings of up to 40 words that some window of the text has word for word."""
    have = licenses.words(text)
    wordings = [(name, licenses.words(w)) for name, every in licenses.TEMPLATES for w in every]
    return {name for name, want in wordings if 0 < len(want) <= 40 and any(have[i : i + len(want)] == want for i in range(len(have)))}


def test_licenses_against_all_windows():
    """Planted notices of up to 40 words in prose: the licenses of all exact windows are found, and no others."""
    rng = random.Random(6)
    short = [(n, w) for n, ws in licenses.TEMPLATES for w in ws if len(licenses.words(w)) <= 40]
    for k in range(40):
        name, text = rng.choice(short)
        other, more = rng.choice(short)
        whole = f"{prose(900 + k, 20)} {text} {prose(901 + k, 30)}" + (f" {more}" if k % 2 else "")
        assert set(_licenses(whole)) == _by_brute_force(whole), (text, more)


@pytest.mark.parametrize("width", [76, 50])
def test_whole_license_files(spark, width):
    """Standard license files in their usual shape: title, copyright line, text wrapped at some width."""
    every = dict(licenses.TEMPLATES)
    rows = []
    for k, name in enumerate(licenses.FULL_TEXTS):
        body = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in every[name][-1].split("\n\n"))
        rows.append((k, f"{name} License\n\nCopyright (c) 2021 Some Body\n\n{body}\n"))
    got = {}
    for r in licenses.scan(table(spark, rows)).collect():
        if r["license"]:
            got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {k: {name} for k, name in enumerate(licenses.FULL_TEXTS)}


def test_license_texts_in_lines(spark):
    clauses = dict(licenses.TEMPLATES)["BSD-3-Clause"][2]
    for k, mark in ((1, "Redistributions of source"), (2, "Redistributions in binary"), (3, "Neither the name")):
        clauses = clauses.replace(mark, f"\n\n{k}. {mark}")
    rows = [(k, "\n".join(textwrap.wrap(dict(licenses.TEMPLATES)[name][3], width))) for k, (name, width) in enumerate([("MIT", 78), ("MIT", 40), ("GPL-3.0", 70), ("Apache-2.0", 30)])]
    rows.append((4, "\n".join(x for part in clauses.split("\n") for x in (textwrap.wrap(part, 76) or [""]))))
    assert _licenses(" ".join(clauses.split())) == ["BSD-3-Clause"]
    assert _licenses("This work is licensed under the GNU General Public License, version\n3. ") == ["GPL-3.0"]
    rows = [(k, f"{prose(k, 9)}\n\n{t}\n\n{prose(k + 50, 9)}") for k, t in rows]
    got = {(r["doc_id"], r["license"], r["first_line"], r["last_line"]) for r in licenses.scan(table(spark, rows)).collect()}
    names = ["MIT", "MIT", "GPL-3.0", "Apache-2.0", "BSD-3-Clause"]
    assert got == {(k, names[k], 2, len(t.split("\n")) - 3) for k, t in rows}


def test_every_license_of_a_block(spark):
    rows = [(1, "Licensed under the MIT License.\nor\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License. Released under the ISC License.")]
    got = sorted((r["doc_id"], r["first_line"], r["last_line"], r["license"]) for r in licenses.scan(table(spark, rows)).collect())
    assert got == [(1, 0, 0, "MIT"), (1, 2, 2, "Apache-2.0"), (2, 0, 0, "ISC"), (2, 0, 0, "MIT")]


# 7: repeated passages


def test_repeated_passages_against_brute_force(spark):
    shared, other = prose(50, 70), prose(51, 55)
    rows = [(1, f"{prose(1, 40)} {shared} {prose(2, 20)}"), (2, f"{shared.upper()} {prose(3, 90)} {other}"), (3, f"{prose(4, 60)}, {other}!"), (4, prose(5, 300)), (5, " ".join(shared.split()[:49])), (6, None), (7, ""), (8, f"{other} {shared}"), (8, f"{other} {shared}"), (9, f"{prose(9, 30)} " * 6)]
    words = {(i, t): _grams(t, 1) for i, t in rows if t}
    where: dict = {}
    for key, ws in words.items():
        for p in range(len(ws) - 49):
            where.setdefault(tuple(ws[p : p + 50]), set()).add(key)
    want = []
    for key, ws in words.items():
        mask = np.zeros(len(ws) + 1, int)
        for p in range(len(ws) - 49):
            if len(where[tuple(ws[p : p + 50])]) > 1:
                mask[p : p + 50] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask])))
        want += [(key[0], int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
    got = [(r["doc_id"], r["first_word"], r["last_word"]) for r in substring_dedup.repeated_passages(table(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 5


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(1, 6, 400), [0]]).astype(np.uint64)
    index = substring_dedup.FMIndex(text, 12, np.zeros(len(text), np.int64))
    plain = text.tolist()
    for _ in range(60):
        n = int(rng.integers(1, 8))
        at = int(rng.integers(0, 380))
        pattern = text[at : at + n] if rng.random() < 0.7 else rng.integers(1, 6, n).astype(np.uint64)
        lo, hi = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            lo, hi = index.step(np.searchsorted(index.symbols, [c]), lo, hi)
        assert max(0, int(hi[0] - lo[0])) == sum(plain[i : i + n] == pattern.tolist() for i in range(len(plain) - n + 1))


# 8: classifier


def test_classifier_on_held_out_labels(spark, docs, texts):
    sf = SF.replace("0.001", "0.01")
    all_texts = {r["doc_id"]: r["text"] for r in common.table(spark, sf, "documents").collect()}
    rows = [(r["doc_id"], r["quality"], r["toxic"]) for r in common.table(spark, sf, "labels").collect() if all_texts.get(r["doc_id"])]
    rows.sort(key=lambda r: (r[0] * 7919) % 10007)
    cut = len(rows) * 7 // 10
    y = np.asarray([r[1:] for r in rows], float)
    model = classifier.train([all_texts[r[0]] for r in rows[:cut]], y[:cut])
    prob, _ = model.predict(pa.array([all_texts[r[0]] for r in rows[cut:]]))
    for head in range(2):
        truth = y[cut:, head]
        base = max(truth.mean(), 1 - truth.mean())
        assert ((prob[:, head] >= 0.5) == truth).mean() >= max(0.85, base - 0.02)
    got = {r["doc_id"]: r for r in classifier.classify(table(spark, [(1, None), (2, " "), (3, prose(1, 5000)), (None, "short")]), model).collect()}
    assert got[1]["quality"] is None and not got[2]["keep"] and 0 <= got[3]["quality"] <= 1 and got[None]["toxic"] is not None


# 10: lines


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _kept_lines(rows: list[tuple], close) -> dict:
    """Texts after line dedup by brute force: every pair of lines is compared by ``close`` of normalised texts."""
    every = [(d is None, d or 0, i, k) for d, t in rows if t for i, k in enumerate(t.split("\n"))]
    w, _, _ = line_dedup.line_words(pa.array([k for *_, k in every]))
    vocab = w.vocab
    norm = [" ".join(vocab[c] for c in w.codes[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    root = list(range(len(every)))
    for i, j in itertools.combinations(range(len(every)), 2):
        if norm[i] and norm[j] and root[i] != root[j] and (norm[i] == norm[j] or close(norm[i], norm[j])):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    least: dict[int, int] = {}
    for i in range(len(every)):
        if root[i] not in least or every[i][:3] < every[least[root[i]]][:3]:
            least[root[i]] = i
    keep = {i for i in range(len(every)) if not norm[i] or least[root[i]] == i}
    want = {}
    for d, t in rows:
        lines = [every[i][3] for i in sorted(keep) if (every[i][0], every[i][1]) == (d is None, d or 0)] if t else None
        if not t:
            want[d] = t
        elif any(c.isalnum() for x in lines for c in x) or len(lines) == len(t.split("\n")):
            want[d] = "\n".join(lines)
    return want


def _similar(a: str, b: str) -> bool:
    return _distance(a, b) <= math.floor(max(len(a), len(b)) * (1 - line_dedup.SIMILARITY) + 1e-9)


def test_line_dedup_against_brute_force(spark):
    """By edit similarity alone, at many lengths, with null and repeated rows."""
    rng = random.Random(8)
    line = prose(60, 40)
    rows = [(1, f"{line}\n{prose(1, 12)}"), (2, f"{prose(2, 12)}\n{line.upper()}!\n\n***"), (3, f"{line.replace(line.split()[3], line.split()[3] + 'x', 1)}\n{prose(3, 12)}"), (4, line), (5, None), (6, ""), (7, f"{prose(7, 8)}\n{prose(7, 8)}"), (None, line)]
    for k, n in enumerate((3, 4, 6, 9, 15, 30, 60)):
        text = prose(600 + k, n)
        rows += [(100 + 3 * k, f"{text}\n{prose(610 + k, 9)}"), (101 + 3 * k, f"{prose(620 + k, 9)}\n{_edited(rng, text, 1)}"), (102 + 3 * k, f"{prose(630 + k, 9)}\n{_edited(rng, text, len(text) // 20)}")]
    want = _kept_lines(rows, _similar)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(table(spark, rows)).collect()}
    assert got == want and 4 not in got and got[2].startswith(prose(2, 12)) and len(got[102 + 3 * 6]) < 80
    twice = line_dedup.drop_lines(table(spark, rows + rows)).collect()
    assert sorted(map(str, (r["text"] for r in twice))) == sorted(map(str, [*want.values(), *want.values()]))


def test_pigeonhole_pairs_are_complete():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base.copy()
    for i in range(40):
        for bit in rng.integers(0, 64, i % 5):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    sigs = np.unique(np.concatenate([base, near]))
    for radius in (1, 3, 5):
        got = [tuple(sorted(p)) for k in range(radius + 1) for part in line_dedup.signed_pairs(sigs, np.arange(len(sigs)), k, radius) for p in part.tolist()]
        want = {(i, j) for i, j in itertools.combinations(range(len(sigs)), 2) if int(np.bitwise_count(sigs[i] ^ sigs[j])) <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_first_places_of_lines():
    rng = random.Random(4)
    rows = [(rng.randrange(6), 0 if (none := rng.random() < 0.2) else rng.randrange(3), rng.randrange(2), rng.randrange(3), none) for _ in range(300)]
    lines = np.array(rows, line_dedup.LINE)
    first, again = line_dedup.first_of(lines)
    least = {h: min((r[4], *r[1:4]) for r in rows if r[0] == h) for h in range(6)}
    assert sorted(r[0] for r, f in zip(rows, first) if f) == list(range(6))
    assert all((r[4], *r[1:4]) == least[r[0]] for r, f in zip(rows, first) if f)
    assert [(r[4], *r[1:4]) != least[r[0]] for r in rows] == again.tolist()


def test_split_groups_verify_alike(spark):
    texts = [prose(70, 30) + " " + "x" * k for k in range(12)] + [prose(71 + k, 30) for k in range(6)]
    named = spark.createDataFrame(list(enumerate(texts)), "hash bigint, norm string")
    pairs = spark.createDataFrame(list(itertools.combinations(range(len(texts)), 2)), "a bigint, b bigint")
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if _distance(texts[a], texts[b]) <= math.floor(max(len(texts[a]), len(texts[b])) * 0.1 + 1e-9)}
    root = list(range(len(texts)))
    for a, b in want:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    for limit in (50_000, 7):
        got = {(r["a"], r["b"]) for r in line_dedup.verified_edges(pairs, named, group_pairs=limit).collect()}
        assert got <= want
        mine = list(range(len(texts)))
        for a, b in got:
            mine = [min(mine[a], mine[b]) if r in (mine[a], mine[b]) else r for r in mine]
        assert mine == root


def test_copies_meet_in_few_pairs(spark):
    """Lines of one group are compared as a chain first; what that connects is no pair again, with or without joins."""
    rows = [(k, f"{prose(80, 40)} {k:03d}") for k in range(60)] + [(100 + k, prose(81 + k, 40)) for k in range(4)]
    met = line_dedup.meet(table(spark, rows))
    near = {(r["a"], r["b"]) for r in met.where(f"kind = {line_dedup.NEAR}").collect()}
    members = sorted({x for pair in near for x in pair})
    assert len(members) == 60 and len(near) < 60 * 59 // 4
    apart = spark.createDataFrame([], "node bigint, component bigint")
    joined = spark.createDataFrame([(x, members[0]) for x in members], "node bigint, component bigint")
    for limit in (1000, 0):
        every = {(r["a"], r["b"]) for r in line_dedup.other_pairs(met, apart, most_known=limit).collect()}
        assert every | near == set(itertools.combinations(members, 2))
        assert line_dedup.other_pairs(met, joined, most_known=limit).isEmpty()


def test_edit_distances_of_many_pairs():
    rng = random.Random(13)
    texts = ["".join(rng.choice("abc é\u4e00") for _ in range(rng.randrange(1, 180))) for _ in range(120)]
    texts += [_edited(rng, t, rng.randrange(len(t) // 5 + 1)) for t in texts]
    x, y = np.r_[0:120, 0:119], np.r_[120:240, 1:120]
    got = line_dedup.similar_pairs(texts, x, y, 0.9)
    assert got.tolist() == [_similar(texts[i], texts[j]) for i, j in zip(x.tolist(), y.tolist())] and 40 < got.sum() < 120


def _edited(rng: random.Random, text: str, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        at, letter = rng.randrange(len(out)), rng.choice("abcdefghijklmnopqrstuvwxyz")
        out[at : at + 1] = rng.choice([[letter], [], [letter, out[at]]])
    return "".join(out)


@pytest.mark.parametrize("n", [10, 15, 19, 30, 39, 60, 79, 120, 160, 240, 319, 330, 700])
def test_line_candidates_against_edit_similarity_alone(n):
    """At every length nine of ten similar pairs share a mark, with one edit and with as many as may be."""
    rng = random.Random(n)
    for edits in (1, n // 10):
        lines = ["".join(rng.choice("etaoinshrdlu ") for _ in range(n - 2)) + "zz" for _ in range(60)]
        other = [_edited(rng, x, edits) for x in lines]
        lens, row, marks, places = line_dedup.line_marks([*lines, *other])
        met = np.array([(m, lens[r], p, r) for r, m, p in zip(row.tolist(), marks.tolist(), places.tolist())], line_dedup.MARK)
        pairs = {tuple(sorted(p)) for part, _ in line_dedup.marked_pairs(met, line_dedup.SIMILARITY) for p in part.tolist()}
        true = [i for i in range(60) if _similar(lines[i], other[i])]
        ends = np.asarray(true)
        assert len(line_dedup.may_be_similar([*lines, *other], ends, ends + 60, line_dedup.SIMILARITY)) == len(true)
        assert all(line_dedup.alike(lines[i], other[i]) for i in true)
        equal = sum(lines[i] == other[i] for i in true)
        assert len(true) >= 40 and equal + sum((i, 60 + i) in pairs for i in true) >= 0.9 * len(true)


def test_edit_similarity_is_exact():
    rng = random.Random(12)
    for _ in range(400):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(8, 30)))
        b = _edited(rng, a, rng.randrange(5)) if rng.random() < 0.8 else "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 30)))
        assert line_dedup.alike(a, b, 0.8) == (_distance(a, b) <= int(max(len(a), len(b)) * (1 - 0.8) + 1e-9)), (a, b)
        assert len(line_dedup.may_be_similar([a, b], np.array([0]), np.array([1]), 0.8)) or not line_dedup.alike(a, b, 0.8)


def test_fuzzy_lines_go(spark):
    """Changes that the words' signature does not bring together: one word of ten, one letter of a short line."""
    long, short = prose(90, 10), "a short line here"
    rows = [(1, long), (2, f"{prose(91, 9)}\n{long[:5]}Q{long[6:]}"), (3, short), (4, f"{prose(92, 9)}\na shart line here")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(table(spark, rows)).collect()}
    assert got == {1: long, 2: prose(91, 9), 3: short, 4: prose(92, 9)}
