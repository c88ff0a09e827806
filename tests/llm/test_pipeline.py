"""The corpus pipeline against what each stage should keep, on a small corpus with planted cases."""

import collections
import random
import re

import pytest

import corpus_pipeline
from assayframe.llm.encode import load_tokenizer


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choice(["an", "the", "re", "on", "er", "st", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = prose(40)
    clean = [prose(rng.randint(80, 300)) for _ in range(60)]
    texts = dict(enumerate(clean))
    texts |= {100 + i: f"Section {i} of the common footer\n{prose(120)}" for i in range(12)}
    texts |= {200: clean[0], 201: clean[0] + " tail", 202: clean[1]}
    texts |= {300: prose(60) + " " + item, 301: item + " " + prose(50)}
    texts |= {400: "short", 401: "be " * 200, 402: None, 403: ""}
    at = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return texts, str(at)


def test_stages(spark, corpus):
    texts, at = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    left = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = step(spark, docs, at)
        assert docs.columns == before, name
        left.append({r.doc_id: r for r in docs.collect()})
    quality, lines, near, clean = left
    assert set(texts) - set(quality) == {400, 401, 402, 403}
    assert set(lines) == set(quality)
    assert all(not lines[i].text.startswith("Section") and lines[i].n_chars == len(lines[i].text) for i in range(100, 112))
    assert set(lines) - set(near) == {200, 201, 202}
    assert set(near) - set(clean) == {300, 301}
    packed = corpus_pipeline.run(spark, at).collect()
    tok = load_tokenizer("word_bpe_49k.json")
    size = {i: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in clean.items()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == size and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, corpus, tmp_path):
    """Nulls in every column, empty texts, repeated and tied rows, clashing columns; and an empty table."""
    texts, at = corpus
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, marks string, component_id string"
    rows = [(None, texts[0], None, None, None), (7, None, "en", None, 3), (7, "", None, "s", None), (8, texts[100], "en", "s", 5), (8, texts[100], "en", "s", 5), (9, texts[9], "en", "s", 1), (9, texts[10], "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)
    want = {"quality_rules": 5, "line_dedup": 8, "near_duplicates": 8, "decontamination": 8}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, at)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == want[name], name
        assert step(spark, docs.limit(0), at).count() == 0, name
    assert corpus_pipeline.best_fit_packing(spark, docs, at).count() == 8
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), at).count() == 0


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def without_recurring_lines(texts, least=10):
    """Texts less the lines that ``least`` of them have exactly or as a template; no text here is mostly such lines."""
    general = lambda t: tuple("<*>" if re.search("[0-9]", w) else w for w in t)
    leaf = lambda t: (len(t), general(t)[:3])
    tokens, exact, lines = collections.defaultdict(set), collections.defaultdict(set), {}
    for i, text in texts.items():
        lines[i] = [(line, tuple(words(line))) for line in (text or "").split("\n")]
        for _, t in lines[i]:
            exact[t].add(i)
            for at, w in enumerate(general(t)):
                tokens[leaf(t), at, w].add(i)
    stable = lambda t: tuple(w if w != "<*>" and len(tokens[leaf(t), at, w]) >= least else None for at, w in enumerate(general(t)))
    templates = collections.defaultdict(set)
    for i, own in lines.items():
        for _, t in own:
            if t and sum(w is not None for w in stable(t)) >= len(t) / 2:
                templates[leaf(t), stable(t)].add(i)
    recurs = lambda t: t and (len(exact[t]) >= least or len(templates.get((leaf(t), stable(t)), ())) >= least)
    return {i: None if texts[i] is None else "\n".join(line for line, t in own if not recurs(t)) for i, own in lines.items()}


def first_of_each_group(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = words((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def uncontaminated(texts, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = {tuple(w[k : k + 13]) for w in map(split, items) for k in range(max(1, len(w) - 12) if w else 0)}
    out = set()
    for i, t in texts.items():
        w = split(t)
        hit = {k + j for p in windows for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p for j in range(len(p))}
        if not (hit and 20 * len(hit) >= len(w)):
            out.add(i)
    return out


def test_pipeline_against_brute_force(spark, corpus):
    """All stages behind the quality rules, which test_operators holds against brute force, over what these keep."""
    texts, at = corpus
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{at}/documents.parquet"), at)
    left = {r.doc_id: r.text for r in docs.collect()}
    item = spark.read.parquet(f"{at}/benchmark.parquet").first().text
    left = without_recurring_lines(left)
    kept = first_of_each_group(left)
    left = {i: t for i, t in left.items() if i in kept}
    kept = uncontaminated(left, [item])
    tok = load_tokenizer("word_bpe_49k.json")
    want = {}
    for i in kept:
        ids = [*tok.encode(left[i], add_special_tokens=False).ids, 0]
        want[i] = [(k // 2048, k, len(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    got, room = collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, at).collect():
        got[r.doc_id].append((r.piece, r.start, r.length))
        room[r.sequence_id].append((r.offset, r.length))
    assert {i: sorted(v) for i, v in got.items()} == want
    for own in room.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
    fullest: list[int] = []  # best fit, the longest pieces first
    for n in sorted((n for v in want.values() for *_, n in v), reverse=True):
        fits = [k for k, used in enumerate(fullest) if used + n <= 2048]
        if fits:
            fullest[max(fits, key=fullest.__getitem__)] += n
        else:
            fullest.append(n)
    assert len(room) <= len(fullest)
