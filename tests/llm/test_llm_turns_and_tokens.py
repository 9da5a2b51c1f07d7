"""Conversation repair, SimHash components and token alignment against plain versions."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexspark.llm import align, repair, simhash

EXTRA = "id conv kept fault key first place sha audit fp node label choice pair pairs times row docs text_ role_".split()
BLANKS = " \t\n\x0b\x0c\r"


def with_extra(df):
    return df.select("*", *(F.lit(7).alias(c) for c in EXTRA))


# --- conversations ------------------------------------------------------------------------------------------------


def plain_cheapest(rows):
    """Least (cost, audit) by a search over all repairs; rows of (initial, wrong)."""
    step = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}
    fit = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        heapq.heappush(heap, (cost + 2, audit + "I", i, fit[state]))
        if i < len(rows):
            initial, wrong = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if wrong != "go":
                more = 1 if wrong == "cut" else 0
                if (initial, state) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, step[initial, state]))
                heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, fit[state]))


def plain_repair(rows):
    """The contract's columns of one conversation's (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = plain_cheapest([(r[:1], {"": "", "truncated": "cut"}.get(f, "go")) for (_, r, _), f in zip(rows, faults, strict=True)])
    lines, i, last = [], 0, ""
    for edit in audit:
        if edit in "IR":
            last = "a" if last == "u" else "u"
            lines.append({"u": "user", "a": "assistant"}[last] + ":" + (rows[i][2] if edit == "R" else ""))
        elif edit == "K":
            last = rows[i][1][0]
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
        i += edit != "I"
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("segment", [1, 2, 5, 64])
def test_least_repairs(segment):
    draw = random.Random(segment)
    for _ in range(400):
        rows = [(draw.choice("sua "), draw.choice(["", "", "", "cut", "go"])) for _ in range(draw.randrange(14))]
        codes = bytes(" sua".index(a) | {"": 0, "cut": 1, "go": 2}[w] << 2 for a, w in rows)
        assert repair.cheapest(codes, segment) == plain_cheapest(rows)


@pytest.mark.parametrize(("hold", "long"), [(60, 4), (60, 100_000), (8_000_000, 4), (8_000_000, 100_000)])
def test_conversations(spark, hold, long):
    draw = random.Random(4)
    texts = ["Yes.", "no", "What?\n ", "", " \t", None, "A. b", "é!", "x\x1c"]
    rows = [(c, draw.choice([None, *range(6)]), draw.choice(["user", "assistant", "system", "user", "", "tool", None]), draw.choice(texts), draw.random() < 0.9) for c in [None, *range(60)] for _ in range(draw.randrange(1, 12))]
    rows += rows[:20] + [(99, 1, "user", "gone.", False)]
    rows += [(100, i, "user", f"{i} {'z' * 30}.", True) for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, here boolean").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(with_extra(df), kept=F.col("here"), hold=hold, long=long).collect()}
    by = defaultdict(list)
    for c, *row, here in rows:
        by[c] += [tuple(row)] if here else []
    assert got == {c: plain_repair(x) for c, x in by.items()}
    assert got[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repaired(df.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    out = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    seen = Counter()
    for r in out:
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        draw = zlib.crc32(key.encode()) % 20
        text, role = (" ", " ") if r.conv_id is None else ("One. Two! Three?", "assistant")
        want = {1: ""}.get(draw, text.translate(str.maketrans("", "", ".!?")) if draw == 2 else text)
        assert (r.kept, r.role, r.text) == (draw != 0, "user" if draw == 4 else role, want)
        seen[key] += 1
        assert seen[key] <= (2 if draw == 3 else 1)
    assert len(seen) == len(rows)


# --- SimHash ------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in BLANKS}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    """The smallest id that each id reaches."""
    least = {i: i for i, _ in nodes}
    for _ in nodes:
        before = dict(least)
        for i, a in nodes:
            for j, b in nodes:
                if linked(a, b):
                    least[i] = min(least[i], least[j])
        if before == least:
            break
    return least


@pytest.mark.parametrize("options", [simhash.SimHashOptions(), simhash.SimHashOptions(small_bucket=1, piece=40), simhash.SimHashOptions(blocks=3)])
def test_simhash(spark, options):
    draw = random.Random(7)
    words = ["".join(draw.choice("abCé") for _ in range(3)) for _ in range(60)]
    texts = [" ".join(draw.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 30, 30, 200, 900)]
    for _ in range(40):
        w = draw.choice(texts).split()
        w[draw.randrange(len(w))] = draw.choice(words)
        texts.append(" ".join(w))
    texts += [None, "", " \n", texts[5], texts[5].upper(), "x\x1cy z", "é\x85"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[6]), (None, "only here without id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in simhash.simhash_components(with_extra(df), options=options).collect()), key=str)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    least = plain_components([(i, f) for i, f in prints if i is not None], lambda a, b: (a ^ b).bit_count() <= 2)
    of = {f: least[i] for i, f in prints if i is not None}
    assert got == sorted(((i, f"{f:016x}", of.get(f)) for i, f in prints), key=str)
    assert simhash.simhash_components(df.limit(0)).collect() == []


def test_close_fingerprints_in_full_buckets(spark):
    """A cloud of fingerprints that share their blocks: links by half-way points join what pairs join."""
    draw = random.Random(3)
    points = {draw.getrandbits(64) for _ in range(30)}
    for _ in range(250):
        points.add(draw.choice(sorted(points)) ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(1, 3))))
    points = sorted(p % (1 << 64) for p in points)
    df = spark.createDataFrame([(simhash._signed(p), k) for k, p in enumerate(points)], "fp long, node long")
    want = plain_components(list(enumerate(points)), lambda a, b: (a ^ b).bit_count() <= 2)
    for small in (1, 4, 1000):
        links = [(r.a, r.b) for r in simhash.close_links(df, simhash.SimHashOptions(small_bucket=small)).collect()]
        assert all((points[a] ^ points[b]).bit_count() <= 2 for a, b in links)
        near = set(links)
        assert plain_components([(k, k) for k in range(len(points))], lambda a, b: (a, b) in near or (b, a) in near) == want


# --- tokens -------------------------------------------------------------------------------------------------------


def plain_alignment(rows):
    """Documents one by one, with both libraries on whole texts."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters, names = align.byte_letters(), {i: t for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for k, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bx, by = [bytes(letters[c] for c in names[i]) for i in x], [piece(i) for i in y]
        links, shown = [], []
        if text and b"".join(bx) == b"".join(by) == f" {text}".encode():
            i = j = p = q = 0
            ga, gb = [], []
            while i < len(x) or j < len(y):
                if p <= q:
                    p, i = p + len(bx[i]), i + 1
                    ga.append(x[i - 1])
                else:
                    q, j = q + len(by[j]), j + 1
                    gb.append(y[j - 1])
                if p == q and ga and gb:
                    links += [(u, v) for u in ga for v in gb]
                    shown.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                    ga, gb = [], []
        else:
            x = y = []
        counts.update(set(links))
        out.append((k, len(x), len(y), len(shown), links, hashlib.sha256(";".join(shown).encode()).hexdigest() if shown else ""))
    best = defaultdict(int)
    for (u, _), c in counts.items():
        best[u] = max(best[u], c)
    return [(k, na, nb, ng, len(links), sum(counts[z] == best[z[0]] for z in links), sum(counts[z] for z in links), sha) for k, na, nb, ng, links, sha in out]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    signs = ["a", "the ", "Über", "\n", "  ", " \n  ", "\t", "123", "'s", "!?", "ß", "漢字", "🙂", " <|endoftext|>", "</s>", "\x1c ", " ", "é", ".", ",", "und "]
    odd = [None, "", " ", "   ", "\n", "a ", " a", "a  b", "▁x y", "x ▁ y", "漢" * 300, "ab" * 2000, "\x00", "a\x00 b", "é" * 50, "x \x85 y", "=" * 700]
    return odd + ["".join(draw.choice(signs) for _ in range(draw.randint(1, 60))) for _ in range(120)]


@pytest.mark.parametrize("options", [align.AlignOptions(), align.AlignOptions(broadcast_pairs=0, units=30, pairs=200, group=3, chunk=50)])
def test_alignment(spark, texts, options):
    rows = [*enumerate(texts), (3, texts[20]), (None, texts[21]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in align.token_alignment(with_extra(df), options=options).collect()), key=str)
    assert got == sorted(plain_alignment(rows), key=str)
    assert align.token_alignment(df.limit(0), options=options).collect() == []


def test_units_are_what_whole_texts_are(texts):
    """Texts cut in units and whole ones, remembered or not, give the same; so does the other library for the first side."""
    o = align.AlignOptions()
    first, second = align._opened("test", *(open(f"{o.folder}/{n}", "rb").read() for n in (o.first, o.second)))
    assert first.cuts_at_blanks and second.cuts_at_blanks
    cut, whole = align.Units(first, second, align.AlignOptions(units=5)), align.Units(first, second, o)
    whole.parts = False
    for some in (texts, texts[::-1], texts[:40]):
        for x, y in zip(cut.documents(some), whole.documents(some), strict=True):
            assert list(map(str, x[:, 1:] if getattr(x, "ndim", 1) == 2 else x)) == list(map(str, y[:, 1:] if getattr(y, "ndim", 1) == 2 else y))


def test_every_token_of_the_first_vocabulary():
    """The fast encoder takes each token's text as the vocabulary's own library does."""
    from tokenizers import Tokenizer

    o = align.AlignOptions()
    data = open(f"{o.folder}/{o.first}", "rb").read()
    texts = [t for b in align.ByteLevel(data).token_bytes if (t := b.decode("utf-8", "ignore"))]
    t = Tokenizer.from_str(data.decode())
    t.encode_special_tokens = True
    assert align.ByteLevel(data).encode(texts, True) == [e.ids for e in t.encode_batch([" " + x for x in texts], add_special_tokens=False)]


def test_marks_and_ranks():
    draw = random.Random(2)
    for _ in range(50):
        n = draw.randint(1, 200)
        cut = lambda: sorted({n, *(draw.randint(1, n) for _ in range(draw.randint(0, 40)))})
        a, b = cut(), cut()
        sizes = [[y - x for x, y in zip([0, *e], e, strict=False)] for e in (a, b)]
        cuts, ra, rb = align.groups(*(np.array(s) for s in sizes), n)
        want = [e for e in a if e in b]
        assert cuts.tolist() == [e - 1 for e in want] and ra.tolist() == [a.index(e) + 1 for e in want] and rb.tolist() == [b.index(e) + 1 for e in want]


# --- earlier operators, mended ------------------------------------------------------------------------------------


def test_vetoes_inside_an_article():
    from lexspark.llm import extract

    page = """<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by X</p><nav><h2>menu</h2></nav></header><div class='side-effects'><p>Side effects are rare.</p></div>
      <div class='comment-list'>no</div><div class='side'>no</div><p class='legal-issues'>Text</p></article><div class='side-effects'>no</div>"""
    assert extract.by_tags(extract.read(page)) == "Title\nSide effects are rare.\nText"


def test_machines_by_products_of_rows():
    """Few rows and many give the same machine, by products of rows or by weights."""
    from lexspark.llm import langid

    draw = np.random.default_rng(1)
    x = draw.random((40, 60)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # as features are
    y = np.where(x[:, 0] > x[:, 1], 1.0, -1.0)
    w, b = langid.train_machine(x, y)
    wide = np.vstack([x, x])  # rows twice, with half the share each: the same loss, by weights
    w2, b2 = langid.train_machine(wide, np.concatenate([y, y]))
    assert len(x) < x.shape[1] + 1 <= len(wide) and np.allclose(w, w2, atol=1e-8) and abs(b - b2) < 1e-8


def test_mix_of_rows_without_id_agrees_on_reruns(spark):
    from lexspark.llm import mixing

    rows = [(None, f"{w} a b c", "en", "s", 1) for w in "pqrstuvwxyz" * 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = [sorted(r.text for r in mixing.mixed(docs.repartition(n)).collect()) for n in (1, 5, 7)]
    assert runs[0] == runs[1] == runs[2]
