"""Each operator against a brute-force version or an exact round trip, on small tables with awkward rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bidlens.llm import chat, decontamination, exact_dedup, language_id, near_dedup, packing, pii, secrets, tokens, toxicity

SCHEMA = "doc_id long, text string, row long, digest string, bucket int, label int, word string, features string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "x", 1, 1, "w", "f") for i, t in rows], SCHEMA)


VOCAB = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "é") for b in ("ra", "ne", "li", "to", "mu", "sch", "x1")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCAB) for _ in range(n))


AWKWARD = [(1, "One Two"), (1, "One Two"), (2, None), (3, ""), (None, "one  two"), (None, None), (4, "\n \t"), (5, "é" * 5), (6, prose(1, 20_000)), (7, "a\x00b"), (8, "😀 😀")]


def test_exact_dedup(spark):
    rows = AWKWARD + [(10 + i, "same\t text") for i in range(50)] + [(9, "same text"), (99, "same text ")]
    got = exact_dedup.exact_duplicates(docs(spark, rows)).collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[4], str(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    # One row of each text; a row goes or stays by its own text, whatever its id.
    assert sorted(map(norm, (r.text for r in kept.collect()))) == sorted(groups)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min((x for x in g if x is not None), default=None)) for g in groups.values())


def test_exact_dedup_settles_colliding_digests_on_bytes(spark):
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "ccc")]
    got = exact_dedup.exact_duplicates(docs(spark, rows), digest=lambda t: F.length(t).cast("string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


def test_exact_dedup_in_several_batches(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    got = exact_dedup.exact_duplicates(docs(spark, rows).repartition(5), files_per_batch=1).collect()
    assert {r.doc_id: r.keep_id for r in got} == {i: i % 7 for i in range(40)}
    assert {r.group_size for r in got} == {5, 6}


def test_exact_dedup_remembers_earlier_calls(spark, tmp_path):
    run = lambda rows: {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs(spark, rows), state_path=f"file://{tmp_path}/state").collect()}
    assert run([(5, "one"), (6, "two"), (7, "one")]) == {5: (5, 2, True), 6: (6, 1, True), 7: (5, 2, False)}
    assert run([(8, "two"), (3, "one"), (9, "new")]) == {8: (6, 2, False), 3: (3, 3, True), 9: (9, 1, True)}
    # Bytes at the locator of an earlier call part texts that share a digest.
    clash = lambda rows: {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs(spark, rows), digest=lambda t: F.length(t).cast("string"), state_path=f"file://{tmp_path}/clash").collect()}
    assert clash([(1, "aa"), (2, "ccc")]) == {1: (1, 1), 2: (2, 1)}
    assert clash([(3, "bb"), (4, "aa")]) == {3: (3, 1), 4: (1, 2)}


def brute_contamination(rows, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= {str(x) for x in ids}
        near = {str(item) for item, text in items if item is not None and is_near(w, words(text))}
        digest = lambda ids: hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest(found), bool(hit), len(near), digest(near)))
    return out


def is_near(doc, item, share=0.7, slop=2):
    """Brute force: every band of differences between positions in the document and in the item."""
    terms = lambda w: [tuple(w[k : k + 2]) for k in range(len(w) - 1)]
    d, t = (terms(doc), terms(item)) if len(item) > 1 else ([(x,) for x in doc], [(x,) for x in item])
    places = [(p - j, j) for j, term in enumerate(t) for p, other in enumerate(d) if term == other]
    return bool(t) and any(len({j for g, j in places if low <= g <= low + 2 * slop}) >= share * len(t) - 1e-9 for low, _ in places)


def test_decontamination(spark):
    items = [(1, prose(50, 30)), (2, prose(51, 12)), (10, "Zebra Quagga okapi"), (11, "hapax"), (12, ""), (13, None), (14, prose(50, 30)), (15, "la la la la la la la la la la la la")]
    a, b = words(items[0][1]), words(items[1][1])
    rows = AWKWARD + [
        (20, " ".join(["x"] * 5 + a + ["y"] * 3)),
        (21, ", ".join(a[:9])),
        (22, "-".join(a[3:13])),
        (23, " ".join(a[:15] + b + a[10:30])),
        (24, "see zebra, QUAGGA! okapi; hapax"),
        (25, "la " * 40),
        (26, " ".join(a[:9] + ["z"] + a[10:])),
        (20, " ".join(a)),
        (27, " ".join(b[:6] + ["z"] + b[7:])),
        (28, " ".join(a[:12] + ["new", "words"] + a[12:20] + a[21:])),
        (29, "zebra some quagga okapi"),
        (30, " ".join(a[:29])),
    ]
    bench = spark.createDataFrame([(i, t, 3, "q") for i, t in items], "item_id long, text string, n int, term string")
    got = [tuple(r) for r in decontamination.contamination(docs(spark, rows), bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_contamination(rows, items)))
    assert [r[6] for r in got if r[0] in (27, 28)] == [1, 2] and not any(r[5] for r in got if r[0] == 27)
    clean = decontamination.drop_contaminated(docs(spark, [*rows, (20, "a clean text of the same id"), (None, "nothing"), (None, "hapax")]), bench)
    assert sorted(str(r.doc_id) for r in clean.collect() if r.doc_id is None or r.doc_id >= 20) == ["20", "21", "27", "29", *["None"] * 3]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, capacity):
    rows = AWKWARD + [(100 + i, prose(i, 1 + i * 7 % 60)) for i in range(60)] + [(200, "<|endoftext|> İstanbul 漢字 don't WE'RE x²")]
    got = packing.pack_documents(docs(spark, rows), TOKENIZER, capacity).collect()
    encoder = packing.WordEncoder(TOKENIZER)
    want = []
    for i, text in rows:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want.append((i, n, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(by) <= -(-sum(r.length for r in got) // capacity) + 1


def test_bin_completion_finds_what_fits():
    assert packing.complete_bin(10, [3, 5, 7], {3: 1, 5: 2, 7: 1}) in ([7, 3], [5, 5])
    assert sum(t for _, t in packing.plan_bins({6: 2, 4: 2, 10: 1}, 10)) == 3
    assert packing.plan_bins({}, 10) == []


def fewest_bins(items, capacity):
    """Brute force: every item into every open bin that has room, or into a new one."""
    items, best = sorted(items, reverse=True), len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for room in set(bins):
            if room >= items[k]:
                at = bins.index(room)
                place(k + 1, [*bins[:at], room - items[k], *bins[at + 1 :]])
        place(k + 1, [*bins, capacity - items[k]])

    place(0, [])
    return best


def test_packing_plans_are_the_best_possible():
    rng = random.Random(7)
    for _ in range(300):
        capacity = rng.randint(8, 40)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        histogram = {size: items.count(size) for size in items}
        plan = packing.plan_bins(histogram, capacity)
        assert sorted(size for pattern, times in plan for size in pattern * times) == sorted(items)
        assert all(sum(pattern) <= capacity for pattern, _ in plan)
        sequences = sum(times for _, times in plan)
        assert packing.lower_bound(histogram, capacity) <= sequences == fewest_bins(items, capacity)


@pytest.mark.parametrize(("sequences", "times"), [(300, 1), (3000, 1), (300, 100_000)])
def test_packing_plans_of_triples_are_near_the_known_least(sequences, times):
    """Lengths made as triples that fill a sequence each, so the least number is known."""
    rng, histogram = random.Random(1), {}
    for _ in range(sequences):
        while not 500 <= 2048 - sum(pair := (rng.randint(500, 900), rng.randint(500, 900))) <= 900:
            pass
        for size in (*pair, 2048 - sum(pair)):
            histogram[size] = histogram.get(size, 0) + times
    plan = packing.plan_bins(histogram, 2048)
    placed = {}
    for pattern, n in plan:
        assert sum(pattern) <= 2048 and n > 0
        for size in pattern:
            placed[size] = placed.get(size, 0) + n
    assert placed == histogram
    assert sequences * times > 300 or plan == packing.plan_bins(histogram, 2048)
    assert sequences * times <= sum(n for _, n in plan) <= 1.005 * sequences * times


def test_packing_plans_of_many_pieces_meet_the_lower_bound():
    rng = random.Random(8)
    mixed = {}
    for _ in range(50_000):
        size = min(2048, int(rng.lognormvariate(5.5, 1.3)) + 1)
        mixed[size] = mixed.get(size, 0) + 1
    for histogram in ({1: 3000}, {2: 2000}, {1: 1100, 2048: 3}, {1025: 9, 1024: 9, 3: 4}, mixed):
        assert sum(times for _, times in packing.plan_bins(histogram, 2048)) == packing.lower_bound(histogram, 2048)


def test_dominated_fillings():
    # Of 10: 7 + 2 leaves room for the spare 3 in place of the 2; 4 + 3 + 3 is full, but 3 + 3 could be a spare 6.
    assert packing.dominated([(7, 1), (2, 1)], 1, 1 << 3)
    assert packing.dominated([(4, 1), (3, 2)], 0, 1 << 6)
    assert not packing.dominated([(4, 1), (3, 2)], 0, 1 << 4 | 1 << 3)
    assert packing.dominated([(7, 1)], 3, 1 << 2)


def test_packing_ids_are_the_tokenizers():
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0x20, 0x7F), 9, 10, 13, *range(0xA0, 0x250), *range(0x2010, 0x2028)]]
    capitals = [c for c in letters if c != c.lower()]
    encoder = packing.WordEncoder(TOKENIZER)
    for _ in range(100_000):
        text = "".join(rng.choice(letters if rng.random() < 0.7 else capitals) for _ in range(rng.randint(1, 12)))
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_packing_of_many_empty_texts(spark):
    rows = [(i, None if i % 2 else "") for i in range(5000)]
    got = packing.pack_documents(docs(spark, rows), TOKENIZER).collect()
    assert sorted(r.doc_id for r in got) == list(range(5000))
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000 and {r.length for r in got} == {1}
    assert max(r.offset for r in got) < 2048 and len({r.sequence_id for r in got}) == 3


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi \\ <|im_end|>\\|"), (1, 1, "assistant", "<|im_start|>assistant\n<"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 0, "a\nb\\n", "é😀"), (3, 1, "assistant", "b"), (3, 0, "user", "a" * 100_000), (3, 1, "assistant", "b")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, loss_start int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(table)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_chat_slices_cover_a_batch():
    import pyarrow as pa

    texts = ["a" * n for n in (10, 500, 3000, 0, 20, 900, 900, 900, 5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["user"] * 9), pa.array(texts)], ["conv_id", "role", "text"])
    parts = list(chat.slices(batch, 1000))
    assert [t for part in parts for t in part.column(2).to_pylist()] == texts
    assert all(part.num_rows == 1 or sum(map(len, part.column(2).to_pylist())) <= 2000 for part in parts)
    for part in parts:
        whole = chat.assemble(["<", part.column(1), "|", part.column(2), ">"], part.num_rows).to_pylist()
        assert whole == [f"<user|{t}>" for t in part.column(2).to_pylist()]


BASE = {"assign": r"(?:(?i:password|passwd|secret|token)|(?i:api)_?(?i:key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def test_secrets():
    import base64
    import gzip
    import urllib.parse

    key = "AKIA" + "Q" * 16
    texts = ["", "token=abc", "Password: 'hunter22'", f"x {key} y AKIA123", "api_key=" + "f" * 30, "secret = token:abcdef", "ſecret=abcdefg", "tokenAPIKEY=x.y.z12"]
    for text in texts:
        want = []
        for kind, pattern in BASE.items():
            for m in re.finditer(pattern, text, re.ASCII):
                size = len(m[1]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)
                want += [(kind, *m.span())] * size
        assert secrets.scan(text)[0] == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    inner = f"see {key} now"
    nested = base64.b64encode(gzip.compress(urllib.parse.quote(inner).replace("A", "\\u0041").encode())).decode()
    text = f"blob {nested} end"
    base, added = secrets.scan(text)
    assert [(s, e) for kind, s, e in added if kind.startswith("access@")] == [(5, 5 + len(nested))]
    base, added = secrets.scan("password%3Dhunter22%21")
    assert not base and added == [("assign@url", 0, 19)]
    assert secrets.scan("%25252525" * 50)[0] == []


def test_secrets_finds_each_place_of_a_repeated_blob():
    blob = base64.b64encode(b"password = hunter22hunter").decode()
    text = f"first {blob} then {blob} end"
    spans = [("assign@base64", at, at + len(blob)) for at in (6, 12 + len(blob))]
    assert secrets.scan(text) == ([], spans)


def decoded_naively(text):
    """Brute force: the leftmost escape, again and again."""
    while m := re.search(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}", text):
        text = text[: m.start()] + chr(int(m[0].lstrip("%\\ux"), 16)) + text[m.end() :]
    return text


def test_secrets_decodes_escapes_to_their_fixpoint():
    rng = random.Random(11)
    for _ in range(20_000):
        text = "".join(rng.choice(["%", "25", "2", "5", "4", "1", "\\", "x", "u00", "%25", "\\x", "\\u0025", "\\u00", "z", "%41"]) for _ in range(rng.randint(1, 12)))
        plain = secrets.unescaped(text)
        assert (plain[0] if plain else text) == decoded_naively(text), text
        if plain:
            spans = [plain[2](k, k + 1) for k in range(len(plain[0]))]
            assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert secrets.unescaped("\\ud83d\\ude00!")[0] == "😀!"
    key = "AKIA" + "Q" * 16
    deep = "%" + "25" * 50_000 + "41" + key[1:]
    assert ("access@url", 0, len(deep)) in secrets.scan(deep)[1]


def test_secrets_in_all_kinds_of_blobs():
    import gzip

    key = "AKIA" + "Q" * 16
    whole = lambda blob, text: [(s, e) for kind, s, e in secrets.scan(text)[1] if kind.startswith("access@")] == [(text.index(blob), text.index(blob) + len(blob))]
    coded = lambda data: base64.b64encode(data).decode().rstrip("=")
    far = b"lorem ipsum, " * 5_500_000 + key.encode()
    for data in (b"\x00\x01" + key.encode() + b"\x00", f"my {key} now".encode("utf-16"), f"my {key} now".encode("utf-16-be"), b"\xff\xfe\xc3 " + key.encode(), gzip.compress(far), gzip.compress(b"one") + gzip.compress(key.encode()), zlib.compress(gzip.compress(key.encode()))):
        assert whole(coded(data), f"see {coded(data)} end"), data[:30]
    for prefix in ("x/", "key_", "path/to/"):
        blob = prefix + coded(gzip.compress(f"the {key}.".encode()))
        assert whole(blob, f"see {blob} end"), prefix
    mime = base64.encodebytes(("some words before " * 5 + key + " and after it " * 5).encode()).decode().strip()
    assert any(kind.startswith("access@") for kind, _, _ in secrets.scan(mime)[1])
    assert secrets.scan("A" * 200_000)[1] == []


def test_secrets_table(spark):
    got = secrets.find_secrets(docs(spark, AWKWARD + [(50, "token=abcdef")])).collect()
    assert len(got) == len(AWKWARD) + 1
    assert [r.spans for r in got if r.doc_id == 50] == ["assign:0:12"]


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_near_dedup(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE, two!"), (5, prose(1, 20_000))]
    for base in range(12):
        text = prose(base, 120).split()
        for copy in range(rng.randint(1, 12)):
            changed = text[:]
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(len(changed))] = "new%d" % rng.randrange(10**6)
            rows.append((len(rows) + 1, " ".join(changed)))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = [rows[root][0] for root in components(len(rows), links)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == want
    kept = near_dedup.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_dedup_of_loose_groups(spark):
    """Two groups of copies with a few changes each: which of them are linked is a matter of chance."""
    rng = random.Random(13)
    rows = []
    for group in range(2):
        text = prose(2000 + group, 120).split()
        for _ in range(220):
            changed = text[:]
            for _ in range(rng.randint(1, 3)):
                changed[rng.randrange(120)] = "w%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(changed)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == components(len(rows), links)


def test_near_dedup_judges_rows_not_ids(spark):
    one, two, three = (prose(seed, 60) for seed in (70, 71, 72))
    rows = [(None, one), (None, one + " more"), (4, one.replace(" ", ", ")), (4, two), (4, two), (None, three), (None, three)]
    kept = [(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs(spark, rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [rows[2], rows[3], rows[5]]))


def test_words_of_very_long_texts():
    import pyarrow as pa

    from bidlens.llm import shingles

    rng = random.Random(17)
    texts = ["".join(rng.choice("ab é ,1") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["x" * 5000, "", "é" * 300]
    whole = shingles.word_hashes(pa.array(texts))
    part, shingles.PART = shingles.PART, 64
    try:
        parts = shingles.word_hashes(pa.array(texts))
    finally:
        shingles.PART = part
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert [b - a for a, b in zip(whole[1], whole[1][1:])] == [len(words(t)) for t in texts]


def test_near_dedup_loses_no_link_of_dissimilar_repetitions(spark):
    """Which half is repeated changes weights, thus bands, but hardly the set of shingles."""
    rows = []
    for base in range(150):
        text = prose(1000 + base, 200).split()
        ends = ["x%dy%d" % (base, k) for k in range(16)]
        rows.append((2 * base, " ".join(text[:100] * 2 + text[100:] + ends)))
        rows.append((2 * base + 1, " ".join(text[:100] + text[100:] * 2 + ends[8:])))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(t) for _, t in rows)]
    assert all(len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1]) for k in range(0, 300, 2))
    assert [got[i] for i, _ in rows] == [i - i % 2 for i, _ in rows]


def test_prob_minhash_estimates_probability_jaccard():
    from bidlens.llm.shingles import prob_minhash

    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**63, 300, dtype=np.uint64)
    weights = rng.uniform(0.5, 2, (2, 300))
    weights[0, 200:] = 0
    weights[1, :60] = 0
    text, shingle, weight = [], [], []
    for t in range(2):
        held = np.flatnonzero(weights[t])
        text += [t] * len(held)
        shingle += list(ids[held])
        weight += list(weights[t, held])
    a, b = prob_minhash(np.array(text), np.array(shingle, np.uint64), np.array(weight), 2, 4096)
    both = np.flatnonzero((weights > 0).all(axis=0))
    exact = sum(1 / np.maximum(weights[0] / weights[0, d], weights[1] / weights[1, d]).sum() for d in both)
    assert abs((a == b).mean() - exact) < 0.03


def test_language(spark):
    rows = [(i, prose(i, 40) if i % 2 else "der die das und nicht ein schön " * 5, "xx" if i % 2 else "de") for i in range(80)]
    rows += [(100, None, "de"), (101, "", "xx"), (102, "123 !!", "xx"), (None, "der die das", None), (103, "z" * 200_000, None)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, n int, bucket int")
    got = language_id.identify(table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:80])
    assert {by[i].lang_pred for i in (100, 101, 102)} == {"und"}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in by if i is not None)
    assert {r.lang_pred for r in language_id.identify(table.filter("lang is null")).collect()} == {"und"}
    assert language_id.identify(table.limit(0)).count() == 0


def toxic_table(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, prose(i, 30) + (" vile scoundrel" if bad else "") + " the muslim neighbours"))
        labels.append((i, 1, int(bad)))
    return docs(spark, rows + [(None, "vile"), (5000, None), (5001, ""), (5002, "scoundrel " * 20_000)]), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    table, labels = toxic_table(spark)
    got = toxicity.assess(table, labels).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert {r.predicted for r in got if r.doc_id in (5000, 5001)} == {0}
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.filter("doc_id < 600").count() == 450
    assert {r.score for r in toxicity.assess(table, labels.limit(0)).collect()} == {0.5}


def test_counterfactual_penalty_evens_out_identity_terms():
    import pyarrow as pa

    texts = ["muslim vile"] * 40 + ["christian fine"] * 60 + ["muslim fine"] * 8 + ["christian vile"] * 4
    label = [int("vile" in t) for t in texts]
    rows = pa.Table.from_batches([toxicity.learnable(pa.array(label, pa.int32()), pa.array(texts))])
    gap = []
    for fairness in (0.0, 50.0):
        weights, _ = toxicity.fit(rows, fairness=fairness, rounds=2000)
        a, b = (weights[toxicity.features(pa.array([w]))[1][0]] for w in ("muslim", "christian"))
        gap.append(abs(a - b))
    assert gap[1] < 0.5 * gap[0]


def test_counterfactual_penalty_covers_all_features_of_a_term():
    import pyarrow as pa

    for one, other in (("muslim", "christian"), ("gay", "lesbian")):
        texts = [f"{one} vile"] * 40 + [f"{other} fine"] * 60 + [f"{one} fine"] * 8 + [f"{other} vile"] * 4
        label = [int("vile" in t) for t in texts]
        rows = pa.Table.from_batches([toxicity.learnable(pa.array(label, pa.int32()), pa.array(texts))])
        gap = []
        for fairness in (0.0, 50.0):
            logits = toxicity._logits(pa.array([f"the {one} neighbours", f"the {other} neighbours"]), toxicity.fit(rows, fairness=fairness, rounds=2000))
            gap.append(abs(logits[0] - logits[1]))
        assert gap[1] < 0.1 * gap[0], gap


def test_swaps_turn_all_terms_of_a_kind():
    import pyarrow as pa

    terms = toxicity.IDENTITY_TERMS["de_status"]
    got = list(toxicity.swapped("Die Flüchtlinge, Flüchtlingen nicht: und FLÜCHTLINGE; bürger"))
    assert len(got) == len(terms) - 1 and got[0] == "Die migranten, Flüchtlingen nicht: und migranten; einwanderer"
    assert list(toxicity.swapped("")) == list(toxicity.swapped("nobody here")) == []
    assert all(term == term.lower() and toxicity._WORD.fullmatch(term) for kind in toxicity.IDENTITY_TERMS.values() for term in kind)
    assert all(len(kind) == len(set(kind)) > 1 for kind in toxicity.IDENTITY_TERMS.values())
    # A word that the text holds anyhow is neither gained nor lost.
    row = toxicity.learnable(pa.array([1, 0], pa.int32()), pa.array(["les juifs et les musulmans", None])).to_pylist()
    assert row[0]["swaps"] == 6 and row[1]["swaps"] == 0 and row[1]["changed"] == []
    own = set(row[0]["buckets"])
    for nth, other in enumerate(toxicity.swapped("les juifs et les musulmans")):
        new = {int(b) for b in toxicity.features(pa.array([other]))[1]}
        changes = [c for s, c in zip(row[0]["swap"], row[0]["changed"], strict=True) if s == nth]
        assert {c for c in changes if c >= 0} == new - own and {~c for c in changes if c < 0} == own - new


def test_neutral_mentions_are_left_alone_in_four_languages():
    """Texts in which one group is mostly named in toxic sentences: the penalty spares neutral mentions and still finds toxic ones."""
    import pyarrow as pa

    rng = random.Random(5)
    said = {
        "en": ("the {} are vile scum", "the {} live near the market", "migrants", "residents"),
        "de": ("die {} sind widerlicher abschaum", "die {} wohnen am markt", "ausländer", "bürger"),
        "fr": ("les {} sont une ordure infecte", "les {} habitent en ville", "musulmans", "catholiques"),
        "es": ("los {} son basura asquerosa", "los {} viven en la ciudad", "judíos", "cristianos"),
    }
    filler = [f"word{i}" for i in range(60)]
    texts, label, neutral, toxic = [], [], [], []
    for bad, fine, target, other in said.values():
        for i in range(300):
            vile = i % 3 == 0
            group = (target if rng.random() < 0.97 else other) if vile else (target if rng.random() < 0.04 else other)
            texts.append(" ".join(rng.sample(filler, 6) + [(bad if vile and rng.random() < 0.5 else fine).format(group)]))
            label.append(int(vile))
        neutral += [" ".join(rng.sample(filler, 6) + [fine.format(target)]) for _ in range(50)]
        toxic += [" ".join(rng.sample(filler, 6) + [bad.format(group)]) for group in (target, other) for _ in range(25)]
    rows = pa.Table.from_batches([toxicity.learnable(pa.array(label, pa.int32()), pa.array(texts))])
    wrong, caught = [], []
    for fairness in (0.0, 1.0):
        model = toxicity.fit(rows, fairness=fairness, rounds=2000)
        wrong.append(int((toxicity._logits(pa.array(neutral), model) >= 0).sum()))
        caught.append(int((toxicity._logits(pa.array(toxic), model) >= 0).sum()))
    print("neutral mentions marked toxic, toxic ones caught (of 200), without and with the penalty:", wrong, caught)
    assert wrong[0] >= 100 and wrong[1] <= 10 and caught[1] >= 190


def test_pii(spark):
    card = "4539 1488 0343 6467"
    rows = AWKWARD + [
        (30, f"mail a.b@c.de, b@x.org_y@z.com; card {card} or 4539148803436468; ip 10.0.0.1 999.1.1.1 1.2.3.4.5"),
        (31, "call +49 (30) 1234-567 or +1 2 or 555-123-4567, ssn 123-45-6789"),
        (32, "9" * 5000 + " " + "x" * 5000 + "@"),
        (33, "+1 (555) 010-9999 😀 a@b.cc"),
    ]
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, text):
        d = re.sub("[^0-9]", "", text)
        return {"email": True, "ip": all(int(p) <= 255 for p in text.split(".") if kind == "ip"), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    want = []
    for i, text in rows:
        spans = [(m.start(), k, m.end()) for k, p in pattern.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
        spans.sort(key=lambda s: (s[0], list(pattern).index(s[1])))
        want.append((i, *[sum(s[1] == k for s in spans) for k in pattern], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()))
    got = pii.find_personal_data(docs(spark, rows)).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(map(str, want))
    assert pii.find_personal_data(docs(spark, rows).limit(0)).count() == 0


def test_em_finds_the_reliable_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        row = ("phone", *[int(truth if rng.random() < p else not truth) for p in (0.95, 0.9, 0.85)], None, None)
        counts[row] = counts.get(row, 0) + 1
    patterns = [(dict(zip(("kind", *pii.LABELERS), row, strict=True)), n) for row, n in counts.items()]
    prior, trust = pii.reliabilities(patterns)
    assert abs(prior["phone"] - 0.4) < 0.05
    assert abs(trust["regex"][0] - 0.95) < 0.04 and abs(trust["cue"][0] - 0.85) < 0.05


def tokens_by_line(encoding, text):
    """Brute force: byte by byte which line it is in; a token counts for the line of most of its bytes, the first of several."""
    line, lines = 0, []
    for byte in text.encode():
        lines.append(line)
        line += byte == 10
    counts, at = [0] * (max(lines, default=-1) + 1), 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        inside = lines[at : at + size]
        counts[max(sorted(set(inside)), key=inside.count)] += 1
        at += size
    return counts


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred != 'und' and lang is not null").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_toxicity_held_out_accuracy(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    got = toxicity.assess(table, labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    toxic, clean = [[r.predicted for r in got if r.toxic == flag] for flag in (1, 0)]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))


def test_pii_added_spans_need_evidence(spark):
    rows = [(i, f"call me: phone {200 + i}-555-01{i:02d} or write") for i in range(40)] + [(100 + i, f"her ssn: {123 + i}-45-67{i:02d}.") for i in range(40)] + [(200, "+1 202-555-0143 x")]
    got = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert all(got[i].spans == "phone_local:15:27" and got[i].n_added == 1 for i in range(40))
    assert all(got[100 + i].spans == "national_id:9:20" for i in range(40))
    # A wider span that overlaps a base one says nothing new.
    assert got[200].spans == "phone:0:15" and got[200].n_added == 0


def test_pii_context_and_gazetteers(spark):
    rows = [(i, f"phone {300 + i}-555-01{i:02d}, {301 + i}-555-02{i:02d}, {302 + i}-555-03{i:02d} end") for i in range(30)] + [(50, "Anna 305-555-0199"), (51, "serial 305-555-0142, 306-555-0142")]
    found = pii.votes(pii.candidates(docs(spark, rows)))
    got = {(r.doc_id, r.start): r for r in found.collect()}
    # Earlier matches of the kind count as one #, so the cue before the first is the third's as well.
    third = got[0, 34]
    assert third.before == "phone #, #, " and third.cue == 1 and third.end == 46
    assert got[50, 5].cue == 1 and got[51, 7].denial == 0 and got[51, 21].denial == 0 and got[51, 21].cue is None
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert all(spans[i] == "phone_local:6:18,phone_local:20:32,phone_local:34:46" for i in range(30)) and spans[51] == ""
    known = {("email", "a@b.DE"): True, ("email", "a@b.zzz"): False, ("ip", "172.31.0.1"): True, ("ip", "172.32.0.1"): False, ("card", "2720 0000 0000 0000"): True, ("card", "2721 0000 0000 0000"): False}
    known |= {("phone", "+353 1 234 5678"): True, ("phone", "+999 1 234 5678"): True, ("phone", "+89 1 234 5678"): False, ("iban", "DE" + "1" * 20): True, ("iban", "DE" + "1" * 19): False, ("national_id", "666-12-3456"): False}
    frame = spark.createDataFrame([(*key, want) for key, want in known.items()], "kind string, match string, want boolean")
    assert [r for r in frame.withColumn("got", pii.in_gazetteer(F.col("kind"), F.col("match"))).collect() if r.got != r.want] == []


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = AWKWARD + [(40, "one\n\n\ntwo\n"), (41, "a\r\nb")]
    got = tokens.token_counts(docs(spark, rows), path).collect()
    encoding, _ = tokens._encoder(path)
    sizes = sorted(len(encoding.encode_ordinary(t or "")) for _, t in rows)
    assert sorted(r.n_tokens for r in got) == sizes
    assert all(sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections for r in got)
    for r, text in ((r, dict(rows)[r.doc_id]) for r in got if r.doc_id in (3, 6, 8, 40, 41)):
        assert r.section_tokens == tokens_by_line(encoding, text or "")
    # "\n\n\n" can be one token over three sections; each rule gives it to one of them
    ends, starts = np.array([3, 6, 9]), np.array([0, 4, 5, 6])
    assert tokens.attribute(ends, starts, 9, "first")[0].tolist() == [2, 0, 0, 1]
    assert tokens.attribute(ends, starts, 9, "majority")[0].tolist() == [2, 0, 0, 1]
    assert tokens.attribute(np.array([2, 9]), np.array([0, 4]), 9, "majority") [0].tolist() == [1, 1]


@pytest.mark.parametrize("run", [exact_dedup.exact_duplicates, near_dedup.near_duplicates, secrets.find_secrets])
def test_empty_tables(spark, run):
    assert run(docs(spark, [])).count() == 0


def test_empty_tables_with_parameters(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    assert decontamination.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(docs(spark, AWKWARD), bench).collect())
    assert tokens.token_counts(none, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_secrets_under_thousands_of_layers():
    data = b"password=hunter22hunter"
    for _ in range(5000):
        data = zlib.compress(data, 0)[:2] + zlib.compress(data, 9)[2:] if len(data) < 200 else zlib.compress(data, 1)
    text = "x " + base64.b64encode(data).decode() + " y"
    base, added = secrets.scan(text)
    assert base == [] and ("assign@base64.deflate*5000", 2, len(text) - 2) in added


def test_secrets_in_an_archive_that_holds_itself(monkeypatch):
    head = b"\x1f\x8b\x08 token=abcdef123 "
    monkeypatch.setattr(secrets, "_inflated", lambda chunks: iter([head]))
    chunks, name = secrets._unpacked(iter([head]), "base64")
    assert b"".join(chunks) == head and name == "base64.deflate"


def test_secrets_in_zlib_behind_a_header():
    packed = base64.b64encode(b"hdr:" + zlib.compress(b"api_key=0123456789abcdef " * 3)).decode()
    assert {s[0] for s in secrets.scan(f"a {packed} b")[1]} == {"assign@base64.deflate"}


def test_scratch_of_two_threads_stays_apart(spark):
    from concurrent.futures import ThreadPoolExecutor

    from bidlens.llm.common import last_stored, materialize, scope

    def work(n):
        def make():
            first = materialize(spark.range(n), "one")
            return materialize(first.selectExpr("id + 1 as id"), "two")

        with scope() as paths:
            out = [last_stored(spark, make) for _ in range(3)]
        return len(paths), [df.count() for df in out]

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, (5, 7))) == [(3, [5] * 3), (3, [7] * 3)]
