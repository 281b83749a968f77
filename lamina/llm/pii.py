"""Personal data: e-mail and IP addresses, card and phone numbers by pattern, and national numbers by a conditional random field.

The linear-chain CRF tags white-space tokens from the shapes of the word and its neighbours. It is trained from a small
labelled table that templates generate with a fixed seed, by gradient descent on the forward-backward likelihood, and
decoded by Viterbi in numpy batches. Only tokens with a digit, and tokens of capital letters in a run with them (as the bank's code
in a bank number), can carry a tag (the others are held at O), so a text falls apart exactly into such runs, each decoded with the
neighbours' words as features: nothing else is left out. Names and other data without a digit aren't among the kinds. A number that
its shape alone doesn't tell is decided by the words before it: ``phone 123-456-7890`` is one, ``version 123-456-7890`` isn't.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lamina.llm.common import as_bytes, map_texts, table
from lamina.llm.spans import Span, beside, digest, report

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that could begin within a run of digits could begin at its start, so runs are tried from their start alone
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
DIGIT = re.compile("[0-9]")
CAPITALS = re.compile(r"""["']*[A-Z]+[.,;:!?"']*\Z""")

#: Tags of the CRF; B and I of a kind follow each other.
TAGS = ("O", "B-national", "I-national", "B-ssn", "B-iban", "I-iban")
KINDS = {"national": 4, "ssn": 5, "iban": 6}
DIM = 1 << 14


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The contract's four kinds. A failing match is dropped, still takes its characters, and isn't tried again from further on."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, "email", m.end()))
            free = m.end()
        # what stands between this "@" and the next can't begin before this one
        free = max(free, at + 1)
        at = text.find("@", free)
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, "card", m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return out


def shape(word: str) -> str:
    """``555-3824`` gives ``3d-4d`` and ``GB29x`` ``2A2da``: digits and capitals as the lengths of their runs, runs of other letters as ``a``."""
    return re.sub(r"[0-9]+|[A-Z]+|[^\W\d_A-Z]+", lambda m: f"{len(m[0])}d" if "0" <= m[0][0] <= "9" else f"{len(m[0])}A" if "A" <= m[0][0] <= "Z" else "a", word)


EDGE = ".,;:!?\"'#"


# Forms of numbers, with # for a digit, N for one from 2 to 9, X for a digit or capital, A for a capital; a bank number's two check digits and groups follow its country.
#: Telephone numbers that their form tells, and those that take a word before them to tell.
PHONES = ("(N##) N##-####", "N##-N##-####", "(N##)N##-####", "(N##) N## ####", "N##.N##.####", "0N ## ## ## ##", "0N.##.##.##.##", "0N# #######", "0N## #######", "0N#/#######", "0N## ######", "0N## ### ####", "020 #### ####", "07### ######", "0## ### ## ##")
CALLED = ("N## ### ###", "9# ### ## ##", "N## ## ## ##", "N##-####", "##########")
BANKS = ("AT## #### #### #### ####", "BE## #### #### ####", "BG## AAAA #### #### #### ##", "CH## #### #### #### #### #", "CZ## #### #### #### #### ####", "DE## #### #### #### #### ##", "DK## #### #### #### ##", "EE## #### #### #### ####", "ES## #### #### #### #### ####", "FI## #### #### #### ##", "FR## #### #### #### #### #### ###", "FR## #### #### #### ##X# #X## ###", "GB## AAAA #### #### #### ##", "GR## #### #### #### #### #### ###", "HR## #### #### #### #### #", "HU## #### #### #### #### #### ####", "IE## AAAA #### #### #### ##", "IT## A### #### #### #### #### ###", "LT## #### #### #### ####", "LU## #### #### #### ####", "LV## AAAA #### #### #### #", "MT## AAAA #### #### #### #### #### ###", "MT## AAAA #### #### XXXX XXXX XXXX XXX", "NL## AAAA #### #### ##", "NO## #### #### ###", "PL## #### #### #### #### #### ####", "PT## #### #### #### #### #### #", "QA## AAAA #### #### #### #### #### #", "QA## AAAA #### #### #### ##XX XXXX X", "QA## AAAA XXXX XXXX XXXX XXXX XXXX X", "RO## AAAA #### #### #### ####", "SE## #### #### #### #### ####", "SI## #### #### #### ###", "SK## #### #### #### #### ####")
OTHERS = ("####-##-##", "##/##/####", "##.##.####", "##:##", "##:##:##", "#", "##", "###", "####", "#####", "######", "#######", "########", "#.##", "#,###", "##.#", "$##.##", "##%", "# ### ###", "## ###", "## ##", "## ## ##", "### ###", "v#.#.#", "#.#.#", "A###", "A#", "AAA-####", "a###a##", "##-##", "978-#-##-######-#", "################", "#### #### #### ####", "#.##.###.##", "x.##@m#.net", "+##", "#### #### ####", "####-####", "##th", "#x#")
CALLS = "tel phone call fax mobile cell contact reach dial ring telefon telephone téléphone tél móvil teléfono handy portable llame telefono cellulare".split()
CODES = "order version invoice item part case ticket ref reference model serial isbn page room section code build release product sku lot batch file record row id tracking parcel bestellung rechnung commande facture pedido factura".split()
FILL = "the of and in to at on is for with by from was le la les de des du et der die das und mit von el los que por con un una my our his number nr no please or".split()
BANKING = "iban account konto compte cuenta bank pay transfer".split()
#: Words that are features of their own; others are all one.
LEXICON = frozenset((*CALLS, *CODES, *BANKING, "ssn", "social", "security", "number", "taxpayer", "no", "nr", "is", "was", "at", "on", "of"))


def features(two: str, before: str, word: str, after: str) -> list[int]:
    """Hashed features of a token, of the two words before it and of the one after."""
    core, last, next_ = word.strip(EDGE), before.strip(EDGE).lower(), after.strip(EDGE)
    known = lambda x: x if x in LEXICON else shape(x) if DIGIT.search(x) else ""
    far = known(two.strip(EDGE).lower())
    names = (f"s{shape(core)}", f"n{sum(c.isdigit() for c in core)}", f"f{core[:2] if core[:1].isalpha() else core[:1]}", f"w{known(last)}", f"v{far}|{known(last)}", f"x{shape(next_) if DIGIT.search(next_) else ''}", f"q{shape(core)}|{known(last)}", f"r{shape(core)}|{shape(next_) if DIGIT.search(next_) else ''}", f"u{shape(core)}|{far}", "b")
    return [zlib.crc32(x.encode("utf-8", "replace")) % DIM for x in names]


def labelled_table(rows: int = 1500, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Sentences of tokens with their tags: numbers of each kind and numbers that are none, by their forms, between words, known ones and made-up ones."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    letters = lambda k, first: "".join(chr(first + x) for x in rng.integers(0, 26, k))
    draw = {"#": lambda: str(rng.integers(0, 10)), "N": lambda: str(rng.integers(2, 10)), "A": lambda: letters(1, 65), "a": lambda: letters(1, 97), "X": lambda: pick("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}

    def form(x: str, keep: int = 0) -> list[str]:
        return (x[:keep] + "".join(draw[c]() if c in draw else c for c in x[keep:])).split()

    def fill() -> list[str]:
        words = [pick(FILL) if rng.random() < 0.5 else letters(int(rng.integers(2, 9)), 97) for _ in range(int(rng.integers(1, 4)))]
        loud = rng.random()
        return [x.upper() for x in words] if loud < 0.2 else [x.title() for x in words] if loud < 0.3 else words

    def numbered(kind: str, groups: list[str]) -> list[str]:
        return [f"B-{kind}", *[f"I-{kind}"] * (len(groups) - 1)]

    out = []
    for _ in range(rows):
        words, tags = [], []

        def add(ws, ts=None, words=words, tags=tags):
            words.extend(ws)
            tags.extend(ts or ["O"] * len(ws))

        for _ in range(3):
            add(fill())
            cue = lambda xs: [x + pick(("", "", ":", ".")) for x in [pick(xs)]] + pick(([], [], [], ["number"], ["no."], ["is"]))
            kind = int(rng.integers(0, 12))
            if kind < 2:
                if rng.random() < 0.5:
                    add(cue(CALLS))
                got = form(pick(PHONES))
                add(got, numbered("national", got))
            elif kind == 2:
                got = form(pick(CALLED))
                cued = rng.random() < 0.5
                add(cue(CALLS) if cued else [])
                add(got, numbered("national", got) if cued else None)
            elif kind == 3:
                if rng.random() < 0.5:
                    add(pick((["ssn"], ["SSN:"], ["social", "security", "number"], ["taxpayer", "id"])) + pick(([], [], ["is"], ["was"], [":"])))
                add(form("###-##-####"), ["B-ssn"])
            elif kind < 6:
                got = form(pick(BANKS), 2)
                if rng.random() < 0.4:
                    got = ["".join(got)]
                add(cue(BANKING) if rng.random() < 0.4 else [])
                add(got, numbered("iban", got))
                add([pick(["BIC", "USD", "EUR", "AND", "THE", "TEL"])] if rng.random() < 0.2 else [])
            elif kind < 8:  # the forms of phone and social security numbers, behind words that say otherwise
                add(cue(CODES))
                add(form(pick((*PHONES[:6], *CALLED, "###-##-####", "###-##-####", "N##-N##-####"))))
            elif kind == 8:  # capitals beside numbers
                add([letters(int(rng.integers(1, 6)), 65), *form(pick(OTHERS[5:13]))])
                add([letters(int(rng.integers(2, 6)), 65)] if rng.random() < 0.5 else [])
            elif kind == 9:
                hexed = "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, 64))
                add([pick((f'"{hexed[:40]}"', hexed[:32], hexed, f"password={hexed[:18]}"))])
            else:
                add(form(pick(OTHERS)))
        add(fill())
        out.append((words, tags))
    return out


def allowed() -> np.ndarray:
    """Transitions: I of a kind only after B or I of it."""
    ok = np.zeros((len(TAGS), len(TAGS)))
    for i, a in enumerate(TAGS):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and a[2:] != b[2:] or b[0] == "I" and a == "O":
                ok[i, j] = -1e4
    return ok


@lru_cache(1)
def train(rounds: int = 50, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(weights of features by tag, transitions), by full-batch AdaGrad on the log-likelihood. Deterministic, a few seconds."""
    runs = []
    for words, tags in labelled_table():
        runs += [([f for f, _ in r], [t for _, t in r]) for r in digit_runs(words, [TAGS.index(t) for t in tags])]
    runs.sort(key=lambda r: -len(r[1]))  # the longest first, so that those with a token at a place are the first ones
    size, k = np.array([len(t) for _, t in runs]), len(TAGS)
    n = int(size[0])
    live = [int((size > p).sum()) for p in range(n)]
    at = (np.repeat(np.arange(len(runs)), size), np.concatenate([np.arange(x) for x in size]))  # run and place of each token
    feats = np.array([f for fs, _ in runs for f in fs], dtype=np.int64)
    gold = np.array([x for _, ts in runs for x in ts], dtype=np.int64)
    told = np.zeros((k, k))
    for _, ts in runs:
        np.add.at(told, (ts[:-1], ts[1:]), 1)
    ok = allowed()
    start = np.array([-1e4 if t[0] == "I" else 0.0 for t in TAGS])
    w, t = np.zeros((DIM, k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    lse = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
    e, alpha, beta = (np.zeros((len(runs), n, k)) for _ in range(3))
    for _ in range(rounds):
        e[at] = w[feats].sum(axis=1)
        tr = t + ok
        alpha[:, 0] = e[:, 0] + start
        for p in range(1, n):
            m = live[p]
            alpha[:m, p] = lse(alpha[:m, p - 1, :, None] + tr, 1) + e[:m, p]
        for p in range(n - 1, 0, -1):
            m = live[p]
            beta[:m, p - 1] = lse(tr + (e[:m, p] + beta[:m, p])[:, None, :], 2)
        z = lse(alpha[np.arange(len(runs)), size - 1], 1)
        prob = np.exp(alpha[at] + beta[at] - z[at[0], None])
        prob[np.arange(len(gold)), gold] -= 1
        dw, dt = np.empty_like(w), -told
        for tag in range(k):
            dw[:, tag] = np.bincount(feats.ravel(), weights=np.repeat(prob[:, tag], feats.shape[1]), minlength=DIM)
        for p in range(1, n):
            m = live[p]
            dt = dt + np.exp(alpha[:m, p - 1, :, None] + tr + (e[:m, p] + beta[:m, p])[:, None, :] - z[:m, None, None]).sum(axis=0)
        dw, dt = dw / len(runs) + 1e-4 * w, dt / len(runs) + 1e-4 * t
        gw += dw * dw
        gt += dt * dt
        w -= rate * dw / np.sqrt(gw)
        t -= rate * dt / np.sqrt(gt)
    return w, t


def digit_runs(words: list[str], extra: list) -> list[list[tuple]]:
    """Maximal runs of words with an ASCII digit or of capitals A-Z alone, those with a digit somewhere: per word its features and its item of ``extra``."""
    runs: list[list[tuple]] = []
    k = 0
    while k < len(words):
        begin, digit = k, False
        while k < len(words) and ((new := DIGIT.search(words[k]) is not None) or CAPITALS.match(words[k])):
            digit |= new
            k += 1
        if digit:
            near = lambda j: words[j] if 0 <= j < len(words) else ""
            runs.append([(features(near(j - 2), near(j - 1), words[j], near(j + 1)), extra[j]) for j in range(begin, k)])
        k += k == begin
    return runs


def viterbi(runs: list[list[list[int]]], w: np.ndarray, t: np.ndarray) -> list[list[int]]:
    """Best tags of runs of feature lists, all runs at once, longest first."""
    order = sorted(range(len(runs)), key=lambda r: -len(runs[r]))
    tr, start = t + allowed(), np.array([-1e4 if x[0] == "I" else 0.0 for x in TAGS])
    lengths = np.array([len(runs[r]) for r in order])
    v, back = None, []
    for p in range(int(lengths[0]) if len(order) else 0):
        n = int((lengths > p).sum())
        e = w[np.array([runs[r][p] for r in order[:n]])].sum(axis=1)
        if v is None:
            v = e + start
        else:
            x = v[:n, :, None] + tr[None]
            back.append(x.argmax(axis=1))
            v[:n] = x.max(axis=1) + e
    out: list[list[int]] = [[] for _ in runs]
    for k, r in enumerate(order):
        tag = int(v[k].argmax())
        path = [tag]
        for p in range(len(runs[r]) - 1, 0, -1):
            tag = int(back[p - 1][k][tag])
            path.append(tag)
        out[r] = path[::-1]
    return out


def crf_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[list[Span]]:
    """Spans of the CRF's kinds in each text, without the punctuation around them."""
    runs, of, places = [], [], []
    for k, text in enumerate(texts):
        if not any(map(text.__contains__, "0123456789")):
            continue
        found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        words = [text[a:b] for a, b in found]
        for run in digit_runs(words, found):
            runs.append([f for f, _ in run])
            places.append([x for _, x in run])
            of.append(k)
    out: list[list[Span]] = [[] for _ in texts]
    for k, place, tags in zip(of, places, viterbi(runs, *model), strict=True):
        held = False  # whether the number that a tag I goes on with is a span of this run
        for (a, b), tag in zip(place, tags, strict=True):
            name, kind = TAGS[tag], TAGS[tag][2:]
            while b > a and texts[k][b - 1] in EDGE:
                b -= 1
            while a < b and texts[k][a] in EDGE:
                a += 1
            if name[0] == "B":
                # a bank number begins with its country and two digits, as a card ends with its check digit
                held = bool(DIGIT.search(texts[k], a, b)) and (kind != "iban" or bool(re.match("[A-Z]{2}[0-9]{2}", texts[k][a:b])))
                if held:
                    out[k].append((a, KINDS[kind], kind, b))
            elif name[0] == "I" and held and b > a:
                out[k][-1] = (*out[k][-1][:3], b)
            else:
                held = held and name[0] == "I"
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans`` (base spans and
    those of the CRF that overlap none; code points, end exclusive) and ``has_personal_data``, whether there is any.

    A null or empty text has no spans: counts 0, an empty ``spans`` and the digest of the empty string.
    """
    model = train()

    def work(ids, texts):
        whole = [t.decode("utf-8", "replace") for t in texts]
        out = {"id": ids, "n_email": [], "n_ip": [], "n_card": [], "n_phone": [], "base_sha256": [], "spans": [], "has_personal_data": []}
        for text, more in zip(whole, crf_spans(whole, model), strict=True):
            base = base_spans(text)
            for kind in ("email", "ip", "card", "phone"):
                out[f"n_{kind}"].append(sum(x[2] == kind for x in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(report(base + beside(more, base)))
            out["has_personal_data"].append(bool(base or more))
        return out

    found = map_texts(as_bytes(docs, id_col, text_col), work, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, has_personal_data boolean")
    return found.withColumnRenamed("id", id_col)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`find_personal_data` of all documents."""
    return find_personal_data(table(spark, sf_dir, "documents"))
