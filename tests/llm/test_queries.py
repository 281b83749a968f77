"""The registered queries on whole tables against brute force or SQL, and operators and stages on awkward tables."""

import hashlib
import itertools
import random
import re
import string
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import PASSAGE, components, plain_fingerprint, reference_encoder

import corpus_pipeline
from lamina.llm import contamination, language, lines, pii, quality, secrets, simhash, vectors
from lamina.llm import bpe, repeats
from lamina.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def texts_of(spark, table="documents", key="doc_id", folder=SF):
    return {r[key]: r.text or "" for r in spark.read.parquet(f"{folder}/{table}.parquet").collect()}


def rows_by_id(df, *columns, key="doc_id"):
    got = [(r[key], tuple(r[c] for c in columns)) for r in df.collect()]
    assert len({i for i, _ in got}) == len(got)
    return dict(got)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def plain_spans(text, kinds):
    """Leftmost, non-overlapping matches of each kind by the contract's own patterns; failing ones are dropped."""
    out = []
    for rank, (kind, pattern, good) in enumerate(kinds):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if good(m)]
    return [x for _, _, x in sorted(out)]


SECRETS = (
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


PRIVATE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


@pytest.mark.parametrize(("name", "kinds"), [("op3_secret_scan", SECRETS), ("op9_personal_data", PRIVATE)])
def test_base_spans(spark, name, kinds):
    folder = "/root/testdata/sf0.01"
    got = rows_by_id(QUERIES[name](spark, folder), "base_sha256", "spans", *(f"n_{k}" for k, _, _ in kinds))
    texts = texts_of(spark, folder=folder)
    assert got.keys() == texts.keys()
    seen = set()
    for i, text in texts.items():
        want = plain_spans(text, kinds)
        seen |= {x.split(":")[0] for x in want}
        assert got[i][0] == sha(",".join(want)) and set(want) <= set(got[i][1].split(",")) | {""}
        assert got[i][2:] == tuple(sum(x.startswith(f"{k}:") for x in want) for k, _, _ in kinds)
    assert len(seen) >= 2


EXTREMES = ["1.2.3.4.5.6.7.8 001.2.3.4 1.2.3.4.", "a@b.c@d.e a@@b.c x.@y..z a@b-.c.", "+1 234 5678 90 +12 (3) 4+5 6.7-8 9 0 1 2", "4111-1111 1111  1111 4111111111111111 0" * 3, "a@b" * 50, "password = 'abc token:token=tokentoken", "AKIA" * 9, "SECRET\"  :  \"x.y=z/+-_ apikey=123456 API_KEY=abcdef", "ſecret=abcdefgh toKen=abcdefgh toKen=abcdefgh", "٣٣٣٣٣٣٣٣٣٣٣٣ +٣12345678901"]


@pytest.mark.parametrize("text", EXTREMES)
def test_base_spans_of_awkward_texts(text):
    for of, kinds in ((secrets, SECRETS), (pii, PRIVATE)):
        assert [f"{k}:{a}:{b}" for a, _, k, b in sorted(of.base_spans(text))] == plain_spans(text, kinds)


LOWERS, UPPERS, MIXED = "qzkvwxjhtrpbnmdgcfwlyxuqkzjv", "XKQZVJWHTRPBNMDGCFWLYXUQKZJV", "DMeh8lQ7zR2xVb9KpTn4WsYc"
RANDOM = [(LOWERS, LOWERS), (UPPERS, UPPERS), (MIXED, MIXED)]
RANDOM += [(f"/home/user/projects/repository/config/production/settings/{x}", x) for x in (LOWERS, UPPERS, MIXED)]
RANDOM += [(f"/some/readable/directories/with/several/ordinary/names/{MIXED}/index/of/files", MIXED), (f"/files/550e8400-e29b-41d4-a716-446655440000/{MIXED}", MIXED)]
ORDINARY = ["internationalization_of_the_configuration", "SOME_LONG_CONSTANT_NAME_2", "getElementsByTagNameAndClassName", "antidisestablishmentarianism", "/files/550e8400-e29b-41d4-a716-446655440000/view", "/usr/local/lib/python3/site-packages/numpy", "D41D8CD98F00B204E9800998ECF8427E"]


def test_random_strings_by_their_ratio(spark):
    """Random letters of one case and random strings behind or amid readable parts are found; ordinary names, paths and digests aren't."""
    cases = RANDOM + [(x, None) for x in ORDINARY]
    frame = spark.createDataFrame([(k, f"see {x} here") for k, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = rows_by_id(secrets.find_secrets(frame), "spans")
    assert {k: s for k, (s,) in got.items()} == {k: f"random:{(a := f'see {x} here'.index(y))}:{a + len(y)}" if y else "" for k, (x, y) in enumerate(cases)}


def plain_gapped(texts, bench, window, near, gap):
    """:func:`plain_near`, and windows in two parts, by trying every pair of alignments and every place between the parts."""
    split = lambda t: WORD.findall(t.translate(LOWER))
    out = {i: set() for i in texts}
    for item, t in bench.items():
        x = split(t)
        size = min(window, len(x))
        least = min(size, near)
        length = min(3, size // (size - least + 1)) if x else 1
        for i, text in texts.items():
            w = split(text)
            rows = {at: [0 <= at + k < len(w) and w[at + k] == y for k, y in enumerate(x)] for at in range(-len(x) - gap, len(w) + gap)}
            for at, a in rows.items():
                for s in range(len(x) - size + 1) if x else ():
                    if sum(a[s : s + size]) >= least:
                        out[i].add(item)
                    for g in range(-gap, gap + 1):
                        b = rows.get(at + g)
                        if not g or b is None or item in out[i]:
                            continue
                        for m in range(s + length, s + size - length + 1):
                            whole = lambda c, p, q: any(all(c[k : k + length]) for k in range(p, q - length + 1))
                            if sum(a[s:m]) + sum(b[m : s + size]) >= least and whole(a, s, m) and whole(b, m, s + size):
                                out[i].add(item)
    return {i: (len(x),) for i, x in out.items()}


def test_gapped_items_against_brute_force(spark):
    """Passages with words put in or left out, and changed ones beside, against every pair of alignments."""
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(25)]
    bench = {i: " ".join(rng.choice(vocabulary) for _ in range(n)) for i, n in enumerate([13] * 5 + [4, 7, 12, 14, 20])} | {30: "a " * 14}
    texts = {0: "", 1: "a " * 30}
    for text in bench.values():
        for put, left, changed in ((0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 0, 0), (0, 1, 0), (0, 2, 1), (1, 0, 3), (0, 1, 4)):
            for _ in range(2):
                w = text.split()
                for k in rng.sample(range(len(w)), min(changed, len(w))):
                    w[k] = "new"
                k = rng.randrange(len(w))
                texts[len(texts)] = " ".join(["x", *w[:k], *(["y"] * put), *w[k + left :], "z"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(bench.items()), "item_id long, text string")
    for gap in (0, 2):
        got = rows_by_id(contamination.mark(docs, items, gap=gap), "n_near")
        assert got == plain_gapped(texts, bench, 13, 10, gap)
    assert sum(x for x, in got.values()) > sum(x for x, in plain_near(texts, bench).values())


ALPHABETS = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_", "base32": string.ascii_uppercase + "234567", "letters": string.ascii_letters, "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "lower and digits": string.ascii_lowercase + string.digits}
HARMLESS = """https://github.com/apache/spark/blob/master/core/src/main/scala/SparkContext.scala https://docs.python.org/3/library/collections.html 2024-01-15-12-30-45-backup
/usr/local/lib/python3/site-packages/numpy getElementsByTagNameAndClassName SOME_LONG_CONSTANT_NAME_2 antidisestablishmentarianism org/apache/hadoop/mapreduce/lib/input
my-awesome-project-name-2024-final-version /var/log/nginx/access.log.2024-01-15 user_profile_image_thumbnail_url AbstractSingletonProxyFactoryBean /home/user/.config/google-chrome/Default/Preferences
https://www.example.com/products/category/item-12345/reviews test_that_the_parser_handles_empty_input application/vnd.openxmlformats-officedocument spark.sql.adaptive.coalescePartitions.enabled
2024-01-15T12:30:45-backup-of-the-database IMG_20240115_123045_HDR report-2023-Q4-final-v2-reviewed kubernetes-dashboard-certs-secret-name ThisIsAVeryLongClassNameForTestingPurposes
/api/v1/users/12345/orders/67890/items Donaudampfschifffahrtsgesellschaftskapitaen rindfleischetikettierungsueberwachungsaufgabe ===================================== -----BEGIN-----------------------------
____________________________ 0000000000000000000000000000 192-168-001-001-255-255-255-000 1234567890123456789012345 2024-11-26/2024-11-27/2024-11-28 MAX_NUMBER_OF_CONCURRENT_CONNECTIONS
https://en.wikipedia.org/wiki/Conditional_random_field node_modules/react-dom/cjs/react-dom-server build/intermediates/javac/release/classes com/google/common/collect/ImmutableList
Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch anticonstitutionnellement/electroencefalografista d41d8cd98f00b204e9800998ecf8427e 550e8400-e29b-41d4-a716-446655440000""".split()


def test_recall_and_precision_of_random_strings():
    """Of random strings of 20 to 40 characters 0.95 or more are found, of each alphabet 0.9; of ordinary long strings 0.05 are reported at most; digits alone never are."""
    enc = bpe.encoding(open(public_tokenizers.path(secrets.RANKS), "rb").read(), public_tokenizers.PATTERN)
    rng, found = random.Random(11), {}
    for name, letters in ALPHABETS.items():
        hits = []
        for k in range(200):
            x = "".join(rng.choice(letters) for _ in range(rng.choice([20, 24, 32, 40])))
            spans = secrets.random_spans(f"{'key' * (k % 2)} {x} end", enc, 2.0)
            hits.append(any(s[3] - s[0] >= len(x) / 2 for s in spans))
        found[name] = sum(hits) / len(hits)
    assert min(found.values()) >= 0.9 and sum(found.values()) >= 0.95 * len(found)
    wrong = [x for x in HARMLESS if secrets.random_spans(f"see {x} here", enc, 2.0)]
    assert len(wrong) <= 0.05 * len(HARMLESS)
    assert not any(secrets.random_spans("".join(rng.choice(string.digits) for _ in range(30)), enc, 2.0) for _ in range(50))


BANK = ["GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00", "IE29 AIBK 9311 5212 3456 78", "IT60 X054 2811 1010 0000 0123 456", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "QA58 DOHB 0000 1234 5678 90AB CDEF G", "GB29NWBK60161331926819"]


def test_bank_numbers_with_groups_of_letters(spark):
    """A spaced bank number is one span, whatever its groups hold; capitals beside numbers are none."""
    texts = [f"pay {x}, please" for x in BANK] + ["FLIGHT BA 249 TO NYC ON 12 MAY 2024", "ISO 9001 AND TEL 42"]
    got = rows_by_id(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "spans")
    assert [got[k][0] for k in range(len(texts))] == [f"iban:4:{4 + len(x)}" for x in BANK] + ["", ""]


def test_a_rejected_bank_number_lends_nothing_to_an_earlier_one():
    text = "pay DE12 3456 7890 1234 and then call XX 12DE 3456 7890 1234 ok"
    assert [text[s[0] : s[3]] for s in pii.crf_spans([text], pii.train())[0]] == ["DE12 3456 7890 1234"]
    texts = ["pay DE12 3456 7890 1234", "3456 7890 and 12DE 3456"]
    assert [len(x) for x in pii.crf_spans(texts, pii.train())] == [1, 0]


#: Sentences that no template made; what stands between braces is a number of the kind that follows the brace.
WRITTEN = """Bonjour, vous pouvez me joindre au {n 06 12 34 56 78} après 18 h.
Mon téléphone : {n 01.44.55.66.77}, merci.
Sie erreichen uns unter {n 030 1234567} von 9 bis 17 Uhr.
Telefon {n 0171 2345678}, Zimmer 312.
Please call {n (743) 555-3824} or {n 212-555-0199} before 5 pm.
You can dial {n 020 7946 0958} from London.
My mobile: {n 07700 900123}.
Llame al {n 612 345 678} por favor.
Fax {n (415)555-2671}, floor 12.
Reach her at {n 305.555.0142} on Monday.
His social security number is {s 219-09-9999}.
SSN: {s 078-05-1120}, born 1961.
The applicant gave {s 457-55-5462} as hers.
Bitte überweisen Sie auf {i DE89 3704 0044 0532 0130 00} bis Freitag.
IBAN {i FR1420041010050500013M02606}.
El IBAN es {i ES91 2100 0418 4502 0005 1332}.
Pay into {i GB29 NWBK 6016 1331 9268 19}, sort code unknown.
Account {i NL91 ABNA 0417 1643 00} is open.
Konto {i AT61 1904 3002 3457 3201}.
Betaal op {i BE68 5390 0754 7034}.
Numero {i IT60 X054 2811 1010 0000 0123 456} intestato a noi.
{i CH93 0076 2011 6238 5295 7} is ours.
{i PL61 1090 1014 0000 0712 1981 2874} jest nasze.
{i SE45 5000 0000 0583 9825 7466} gäller.
Order 123-45-6789 has shipped.
Version 123-456-7890 is out.
See invoice 555-12-3456 and ticket 800-555-0100.
Model 212-555-0147 sold out in 2023.
On 2024-01-15 at 12:30 there were 1 234 567 visitors.
Rows 10 20 30 40 50 are empty.
Flight BA 249 leaves at 18:45 from gate 12.
ISO 9001 AND EN 60601 APPLY.
ISBN 978-3-16-148410-0 is a fixed example.
The ratio was 3.14159 to 2.71828, or 115 %.
Chapter 12, section 3.4.5, page 678.
In 1999 and 2000 the 42 teams played 861 matches.
Card 4111 1111 1111 1111 was declined on 12/05.
Part A123 fits the XJ 220 and the F 40.
He ran 10 000 m in 27 min 31 s.
Build 20240115 of release v2.10.3 failed after 1500 ms.""".split("\n")


def test_recall_and_precision_of_the_crf():
    """Per kind, 0.9 of the numbers in sentences written by hand are found as one span, and 0.9 of what is found is right."""
    kinds, want, texts = {"n": "national", "s": "ssn", "i": "iban"}, [], []
    for line in WRITTEN:
        text, spans = "", []
        for k, part in enumerate(re.split(r"[{}]", line)):
            if k % 2:
                spans.append((kinds[part[0]], len(text), len(text) + len(part) - 2))
                part = part[2:]
            text += part
        texts.append(text)
        want.append(spans)
    got = [[(k, a, b) for a, _, k, b in x] for x in pii.crf_spans(texts, pii.train())]
    for kind in kinds.values():
        true = {(k, x) for k, spans in enumerate(want) for x in spans if x[0] == kind}
        found = {(k, x) for k, spans in enumerate(got) for x in spans if x[0] == kind}
        assert len(true & found) >= 0.9 * len(true) and len(true & found) >= 0.9 * len(found), (kind, true - found, found - true)


def test_viterbi_against_all_paths():
    """The best path of short runs, by trying every sequence of tags."""
    rng = np.random.default_rng(3)
    w, t = rng.normal(size=(40, len(pii.TAGS))), rng.normal(size=(len(pii.TAGS), len(pii.TAGS)))
    runs = [rng.integers(0, 40, (n, 5)).tolist() for n in (1, 2, 3, 4, 4, 2, 1)]
    move, start = t + pii.allowed(), [-1e4 if x[0] == "I" else 0.0 for x in pii.TAGS]
    for run, path in zip(runs, pii.viterbi(runs, w, t), strict=True):
        e = [w[x].sum(axis=0) for x in run]
        score = lambda p: start[p[0]] + sum(e[k][x] for k, x in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert path == list(max(itertools.product(range(len(pii.TAGS)), repeat=len(run)), key=score))


def test_simhash_query(spark):
    texts = texts_of(spark)
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    lab = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert rows_by_id(QUERIES["op4_simhash_near_dedup"](spark, SF), "fingerprint", "component_id") == {i: (f"{fps[k]:016x}", ids[lab[k]]) for k, i in enumerate(ids)}


def test_simhash_of_a_repeated_id(spark):
    """An id with two texts belongs to the groups of both, which it joins."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, text(1)), (1, text(2)), (2, text(1)), (3, text(2).upper()), (4, text(4)), (5, text(1).title())]
    got = simhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 1)]
    fps = spark.createDataFrame([(7, 0b0), (7, (1 << 62) - 1), (8, 0b101), (9, (1 << 62) - 2)], "id long, fp long")
    assert {(r.fp, r.component) for r in simhash.near_components(fps).collect()} == {(0, 7), ((1 << 62) - 1, 7), (0b101, 7), ((1 << 62) - 2, 7)}


def plain_contamination(texts, bench):
    windows = defaultdict(set)
    for item, text in bench.items():
        w = WORD.findall(text.translate(LOWER))
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in texts.items():
        w = WORD.findall(text.translate(LOWER))
        hit, items = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if got := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    items |= got
        out[i] = (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w))
    return out


CONTRACT6 = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination_query(spark):
    want = plain_contamination(texts_of(spark), texts_of(spark, "benchmark", "item_id"))
    df = QUERIES["op6_benchmark_decontamination"](spark, SF)
    assert rows_by_id(df, *CONTRACT6) == want and any(x[4] for x in want.values())
    assert df.where("n_near < n_items").count() == 0


def test_contamination_of_repetitive_items(spark):
    """Windows of few different words, items that share windows, short items, and letters that only differ beyond ASCII."""
    texts = {1: "a b " * 40, 2: "b a b", 3: "É a b c", 4: "é a b c", 5: "x " * 200 + "a b " * 7, 6: "A-B a_b", 7: ""}
    bench = {1: "a b " * 7, 2: "a b " * 6 + "c", 3: "b a", 4: "é a b", 20: "x " * 30, 5: "", 6: "zz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(bench.items()), "item_id long, text string")
    assert rows_by_id(contamination.mark(docs, items), *CONTRACT6) == plain_contamination(texts, bench)


def plain_near(texts, bench, window=13, near=10):
    """Per text the number of items with ``near`` words of a window in place, by trying every alignment."""
    split = lambda t: WORD.findall(t.translate(LOWER))
    items = {i: w for i, t in bench.items() if (w := split(t))}
    out = {}
    for i, text in texts.items():
        w, found = split(text), set()
        for item, x in items.items():
            size = min(window, len(x))
            for at in range(-len(x), len(w)):
                same = [0 <= at + k < len(w) and w[at + k] == y for k, y in enumerate(x)]
                if any(sum(same[s : s + size]) >= min(size, near) for s in range(len(x) - size + 1)):
                    found.add(item)
        out[i] = (len(found),)
    return out


@pytest.mark.parametrize(("window", "near"), [(13, 10), (13, 13), (5, 2), (8, 6)])
def test_near_items_against_brute_force(spark, window, near):
    """Passages of one window and of more with one to four words changed, the rarest and words that occur nowhere else among them; cut, short and doubled ones."""
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(30)]
    bench = {i: " ".join(rng.choice(vocabulary) for _ in range(n)) for i, n in enumerate([13] * 12 + [1, 2, 3, 4, 9, 10, 11, 12, 14, 30])}
    bench |= {50: "only here " + bench[0].split(" ", 2)[2], 51: "a " * 13, 52: ""}
    texts = {}
    for text in bench.values():
        for changed in range(5):
            for _ in range(3):
                w = text.split()
                for k in rng.sample(range(len(w)), min(changed, len(w))):
                    w[k] = rng.choice([*vocabulary, "new"])
                side = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4))) for _ in range(2)]
                texts[len(texts)] = " ".join([side[0], *w[rng.randrange(2) :], side[1]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(bench.items()), "item_id long, text string")
    got = contamination.mark(docs, items, window=window, near=near)
    assert rows_by_id(got, "n_near") == plain_near(texts, bench, window, near)


def test_bpe_query(spark):
    enc = reference_encoder()
    want = {i: ((ids := enc.encode_ordinary(t)) and len(ids) or 0, sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(t)) for i, t in texts_of(spark).items()}
    assert rows_by_id(QUERIES["op7_byte_bpe"](spark, SF), "n_tokens", "ids_sha256", "decoded_sha256") == want


def plain_lines(texts):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in texts.items()}


def test_lines_after_inserts_and_deletes(spark, monkeypatch):
    """Through a stored index, what stays after each change is what a new start on the documents then held gives; filters are changed, not rebuilt."""
    text = lambda ks: "\n".join(f"a line that is number {k} of many" for k in ks)
    texts = {i: text(range(i % 7, 400, 1 + i % 5)) for i in range(12)}
    frame = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
    index, held = lines.LineIndex.of(frame(range(4))).stored(), set(range(4))
    for change, ids in (("insert", range(4, 10)), ("delete", [9, 5, 4, 0]), ("insert", [0, 10, 11]), ("delete", [10, 11, 8, 7, 6, 0]), ("insert", [5])):
        index = getattr(index, change)(frame(ids))
        held = held | set(ids) if change == "insert" else held - set(ids)
        want = plain_lines({i: texts[i] for i in held})
        with monkeypatch.context() as m:
            m.setattr(lines, "filters", None)
            got = lines.drop_lines(frame(held), index=index)
            assert {r.doc_id: bytes(r.kept).decode() for r in got.collect()} == want
            assert {r.doc_id: r.text for r in lines.without_lines(frame(held), index=index).collect()} == want
        h = {bytes(r.key) for r in index.keys.collect()}
        tables = {r.shard: lines.Cuckoo(table=lines.np.frombuffer(r.filter, dtype="uint16").reshape(-1, 4)) for r in index.shards.collect()}
        assert sum(int((f.table > 0).sum()) for f in tables.values()) == len(h)
        for k in h:
            shard, x = lines._halves([k])
            assert tables[int(shard[0])].has(x).all()


def plain_groups(texts):
    """The least id of the group of each text, by comparing all pairs of wide fingerprints that share a band."""
    ids, radius = sorted(texts), simhash.radius_of(0.8)
    found = [simhash.wide_fingerprint(texts[i].encode()) for i in ids]
    bits = [int.from_bytes(f, "big") for f, _ in found]
    near = lambda a, b: (bits[a] ^ bits[b]).bit_count() <= radius and any(x == y for x, y in zip(found[a][1], found[b][1], strict=True))
    lab = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if near(a, b)])
    return {i: ids[lab[k]] for k, i in enumerate(ids)}


@pytest.mark.parametrize("parts", [64, 256])
def test_lines_dealt_to_their_filters(spark, monkeypatch, parts):
    """Where filters are too large to send, the lines go to them: the same documents lose the same lines."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(lines, "FILTER_BYTES", -1)
    monkeypatch.setattr(lines, "shards_for", lambda n: parts)
    got = {r.doc_id: bytes(r.kept).decode() for r in lines.drop_lines(docs).collect()}
    assert got == plain_lines(texts_of(spark)) and any(r.n_dropped for r in lines.drop_lines(docs).collect())
    assert [lines.shards_for.__name__, len({lines._halves([bytes([k] * 16)], parts)[0][0] for k in range(256)})] == ["<lambda>", parts]


def test_shards_grow_with_the_keys(spark):
    assert [lines.shards_for(n) for n in (0, 10, 1 << 18, 1 << 24, 1 << 26, 1 << 40)] == [64, 64, 64, 128, 512, 1 << 16]
    keys = spark.createDataFrame([(bytes(random.Random(k).randrange(256) for _ in range(16)),) for k in range(50)], "key binary")
    for parts in (64, 4096):
        for r in keys.select("key", lines.shard_of("key", parts).alias("s")).collect():
            assert r.s == lines._halves([bytes(r.key)], parts)[0][0]


def test_pipeline_against_brute_force(spark):
    """Each stage is compared with a plain version of it on what its predecessor kept; stage 1 with the weights of all documents."""
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = read("documents")
    good = {r.doc_id for r in quality.resample(docs, read("labels")).where("kept").collect()}
    texts = {i: t for i, t in texts_of(spark).items() if i in good}
    texts = plain_lines(texts)
    groups = plain_groups(texts)
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    marks = plain_contamination(texts, texts_of(spark, "benchmark", "item_id"))
    texts = {i: t for i, t in texts.items() if not marks[i][4]}
    enc = reference_encoder()
    want = {i: (len(enc.encode_ordinary(t)), sha(t)) for i, t in texts.items()}
    assert rows_by_id(corpus_pipeline.run(spark, SF), "n_tokens", "decoded_sha256") == want


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_recall_of_near_copies(spark):
    """Of the pairs of different texts with a Jaccard similarity of five-word shingles of 0.8 or more, at least 0.95 are in one group; who goes has a near copy that stays."""
    folder = "/root/testdata/sf0.01"
    texts = {i: t for i, t in texts_of(spark, folder=folder).items() if t.split()}
    kept = {r.doc_id for r in simhash.keep_one(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    groups = plain_groups(texts)
    assert {i for i in texts if groups[i] == i} == kept & texts.keys()
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for v in holders.values() if len(v) < 99 for k, b in enumerate(v) for a in v[:k]}
    share = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    near = [p for p, j in share.items() if j >= 0.8]
    assert len(near) > 20 and sum(groups[a] == groups[b] for a, b in near) >= 0.95 * len(near)
    gone = texts.keys() - kept
    assert gone == {x for x in gone if any(j >= 0.55 and x in p for p, j in share.items())}


def test_rows_of_repeated_ids_are_told_apart(spark):
    """Of an id that repeats, clean and different rows stay, near copies and contaminated ones go, and a group keeps one row."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(3)), (3, text(4)), (4, text(3)), (5, text(5)), (5, text(5).upper()), (None, text(1)), (6, None), (6, text(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in simhash.keep_one(docs).collect())
    assert got == sorted([(0, text(1)), (1, text(1)), (2, text(2)), (3, text(3)), (3, text(4)), (5, text(5)), (6, ""), (6, text(6))])
    bench = spark.createDataFrame([(1, text(3)), (2, text(1))], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in contamination.without_benchmark(docs, bench).collect())
    assert got == sorted((i or 0, t or "") for i, t in rows if i is None or t not in (text(1), text(3)))


def test_every_language_is_learned(spark, monkeypatch):
    """More labels than 256, and a language whose text lies in a few long documents, of which the hash alone draws none."""
    few = [(k, f"l{k:03}", f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * (40 + k)) for k in range(300)]
    model = language.train(spark.createDataFrame(few, "doc_id long, lang string, text string"))
    assert model.langs == [f"l{k:03}" for k in range(300)]
    got = rows_by_id(language.predict(spark.createDataFrame(few, "doc_id long, lang string, text string"), model), "lang_pred")
    assert got == {k: (name,) for k, name, _ in few}
    monkeypatch.setattr(language, "SAMPLE_CHARS", 10)
    long = [(k, "xx", "the cat and the hat " * 500) for k in range(30)] + [(99, "ru", "кот и шляпа " * 500)]
    frame = spark.createDataFrame(long, "doc_id long, lang string, text string")
    assert set(rows_by_id(language.predict(frame, language.train(frame)), "lang_pred").items()) == {(i, (name,)) for i, name, _ in long}


CLASH = "key long, piece string, n double, w int, term string, id long, doc long, v int, k int, h long, label int, spans string, count int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Documents with nulls in any column, a null id twice, a repeated row, empty and long texts, and columns named as the operators' own."""
    rows = [(1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (5, " ".join(f"w{k}" for k in range(60_000)) + " " + PASSAGE), (6, "\n" * 5000), (7, "é" * 3000), (None, PASSAGE), (None, None), (8, "  \t"), (9, "a" * 200_000), (10, "1 " * 30_000), (-5, PASSAGE)]
    base = spark.createDataFrame([(i, t, None if k % 2 else "en", None, None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    extra = [F.lit(None if k % 2 else 3).cast(c.split()[1]).alias(c.split()[0]) for k, c in enumerate(CLASH.split(", "))]
    return base.select("*", *extra).cache()


OPERATORS = {
    "quality": lambda d: quality.resample(d, d.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(1).alias("toxic"), "text")),
    "secrets": secrets.find_secrets,
    "simhash": simhash.near_documents,
    "lines": lines.drop_lines,
    "contamination": lambda d: contamination.mark(d, d.select(F.col("doc_id").alias("item_id"), "text", "n", "term").where("length(text) < 5000 or text is null")),
    "bpe": bpe.digests,
    "repeats": repeats.remove_repeats,
    "private": pii.find_personal_data,
    "language": lambda d: language.predict(d, language.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(awkward, name):
    out = OPERATORS[name](awkward)
    assert sorted(r.doc_id or 0 for r in out.select("doc_id").collect()) == sorted(r.doc_id or 0 for r in awkward.select("doc_id").collect())
    none = OPERATORS[name](awkward.where("doc_id = 77"))
    assert none.count() == 0 and none.schema == out.schema


def test_awkward_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 5), (2, [2.0, 0.0], 1, None), (None, [1.0, 0.0], 1, 5), (3, [1.0, 0.0], None, 5), (4, [float("inf"), 0.0], 1, 5), (5, [1e300, 1e280], 1, 5), (6, [1e-300, 0.0], 1, 5), (7, [1.0, 0.0, 0.0], 1, 5)], "vec_id long, embedding array<double>, label int, cell int").withColumn("n_links", F.lit(3))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect())
    assert got == [(0, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 3, 1, False), (6, 3, 1, False), (7, 0, 7, True)]
    assert vectors.near_vectors(frame.where("vec_id > 9")).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (3, [-0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(two).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]


@pytest.fixture(scope="module")
def odd_folder(awkward, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    awkward.select(F.col("doc_id").alias("item_id"), "text", "n", "term").where("length(text) < 5000 or text is null").write.parquet(f"{folder}/benchmark.parquet")
    awkward.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"), "text", "key").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_awkward_stages(spark, awkward, odd_folder, stage):
    apply = dict(corpus_pipeline.STAGES)[stage]
    last = stage == corpus_pipeline.STAGES[-1][0]
    for docs in (awkward, awkward.where("doc_id = 77")):
        out = apply(spark, docs, odd_folder)
        got = out.collect()
        assert len(got) <= docs.count() and (docs is awkward) == bool(got)
        assert last or out.columns == docs.columns
