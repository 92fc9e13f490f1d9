import random

import pytest
from junctura.operators import placement, sequence
from junctura.sources import sections, tables, text


def write(folder, name, body):
    (folder / name).write_text(body)
    return str(folder / name)


def small_splits(spark, n):
    spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture()
def cut(spark):
    small_splits(spark, "90b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def block(i, chr_, exons):
    return f"----------\ngenes[{i}] =\nstarts = {','.join(str(s - 1) for s, _ in exons)},\nends = {','.join(str(e) for _, e in exons)},\nstrand = +\nchr = {chr_}\n" + "".join(f"{s}-{e}\n" for s, e in exons)


def test_blocks_that_files_are_cut_within(spark, tmp_path, cut):
    rng = random.Random(1)
    want = []
    for f in range(3):
        body = ""
        for k in range(40):
            ends, exons = 10, []
            for _ in range(rng.randint(1, 6)):
                s = ends + rng.choice([5, 21, 22, 300])
                ends = s + rng.randint(1, 90)
                exons.append((s, ends))
            want.append((100 * f + k, f"chr{k % 3}", exons))
            body += block(*want[-1])
        write(tmp_path, f"tx{f}.txt", body)
    got = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    assert got > 50  # records straddle the splits
    found = sections.transcript_blocks(spark, str(tmp_path))
    assert sorted((r.id, r.chr, [tuple(x) for x in r.exons]) for r in found.collect()) == sorted(want)
    short = {(c, a, b, s, e) for _, c, x in want for (a, b), (s, e) in zip(x, x[1:]) if s - b - 1 <= 20}
    introns = [tuple(r) for r in sections.short_introns(found).collect()]
    assert len(introns) == len(set(introns)) and set(introns) == short


@pytest.mark.parametrize(
    "body, error",
    [("genes[1] =\n" + block(2, "c", [(1, 5)]), "no block begins"), ("---\nstarts = 1,\nends = 2,\nchr = c\n", "no id"), ("---\ngenes[1] =\nends = 2,\nchr = c\n", "no starts"), ("---\ngenes[1] =\nstarts = 1,\nends = 2,\n", "no chr"), ("---\ngenes[1] =\nstarts = 1,4,\nends = 2,\nchr = c\n", "differ in number")],
)
def test_faulty_blocks(spark, tmp_path, body, error):
    with pytest.raises(Exception, match=error):
        sections.transcript_blocks(spark, write(tmp_path, "t.txt", body)).collect()


def test_introns_without_bases(spark, tmp_path):
    t = sections.transcript_blocks(spark, write(tmp_path, "t.txt", block(1, "c", [(1, 5), (6, 9)])))
    with pytest.raises(Exception, match="an intron of 0 bases"):
        sections.short_introns(t).collect()


def genome(seed=2):
    rng = random.Random(seed)
    seqs = {f"chr{k}": "".join(rng.choice("ACGT") for _ in range(n)) for k, n in ((1, 1000), (2, 64), (3, 1))}
    return seqs | {"chrR": "GATTC" + "CA" * 400 + "GG" + "T" * 333 + "ACGT" * 50}


def fasta(seqs, width=37):
    return "".join(f">{c} some words\n" + "".join(s[i : i + width].lower() + "\n" for i in range(0, len(s), width)) for c, s in seqs.items())


def test_tiles_and_slices_are_substrings(spark, tmp_path, cut):
    seqs = genome()
    write(tmp_path, "a.fa", fasta(dict(list(seqs.items())[:2])))
    write(tmp_path, "b.fa", fasta(dict(list(seqs.items())[2:]), 80))
    tiles = sections.fasta_tiles(spark, str(tmp_path), tile=50)
    got = {}
    for r in sorted(tiles.collect(), key=lambda r: (r.chr, r.tile)):
        assert len(r.seq) <= 50
        got[r.chr] = got.get(r.chr, "") + r.seq
    assert got == seqs
    rng = random.Random(3)
    asks = [(c, s, s + rng.randint(-1, 170)) for c in seqs for s in (1, 2, 50, 51, rng.randint(1, 900))] + [("chr9", 1, 5), ("chr1", 990, 2000)]
    found = sequence.slices(spark.createDataFrame(asks * 2, "chr string, s int, e int"), tiles, 50).collect()
    assert len(found) == 2 * len(asks) and all(r.seq == seqs.get(r.chr, "")[r.s - 1 : max(r.e, 0)] for r in found)


def moves(seq, low, high, t, size, event, op):
    """How far an indel can move within low..high, base by base."""
    a, b = seq[low - 1 : t - 1], seq[t - 1 + (size if op == "D" else 0) : high]
    left = right = 0
    while left < len(a) and a[-1 - left] == event[-1 - left % size]:
        left += 1
    while right < len(b) and b[right] == event[right % size]:
        right += 1
    return left, right


def test_indel_table_to_shift_table_to_scores(spark, tmp_path):
    seqs, rng, lines, want = genome(), random.Random(5), [], set()
    for k in range(150):
        c = rng.choice(["chr1", "chrR", "chrR"])
        low = rng.randint(1, 300)
        high = min(len(seqs[c]), low + rng.randint(300, 1000))
        pos, size = rng.randint(1, high - low - 12), rng.randint(1, 6)
        t = low + pos
        op = rng.choice("ID")
        event = seqs[c][t - 1 : t - 1 + size] if op == "D" or rng.random() < 0.7 else "ACCTGA"[:size]
        lines.append(f"{c}:{low}-{high}\t{pos}\t{'-' if op == 'D' else ''}{size}\t{event}")
        want.add((c, op, t, size, *moves(seqs[c], low, high, t, size, event, op), low, high, event))
    tiles = sections.fasta_tiles(spark, write(tmp_path, "g.fa", fasta(seqs)), tile=100)
    found = sequence.indel_shifts(sections.simulated_indels(spark, write(tmp_path, "indels.txt", "\n".join(lines) + "\n")), tiles, 100)
    assert sorted(map(tuple, found.collect())) == sorted(w[:6] for w in want)
    assert max(w[5] for w in want) > 300  # several rounds
    tables.write_shifts(found, str(tmp_path / "shifts"))
    read = text.shifts(spark, str(tmp_path / "shifts"))
    assert sorted(map(tuple, read.collect())) == sorted(w[:6] for w in want if w[4] or w[5])
    # a read whose deletion was reported as far to the right as it can go, 40 bases at most, is perfect
    dels = sorted({(w[0], w[2], w[3], min(w[5], 40)) for w in want if w[1] == "D"})
    schema = "frag long, mate int, amb boolean, flag int, chr string, pos int, cigar string"
    t = spark.createDataFrame([(i, 1, False, 65, c, at - 20, f"20M{n}D56M") for i, (c, at, n, _) in enumerate(dels)], schema)
    r = spark.createDataFrame([(i, 1, False, 65, c, at - 20, f"{20 + k}M{n}D{56 - k}M") for i, (c, at, n, k) in enumerate(dels)], schema)
    assert {x["verdict"] for x in placement.verdicts(placement.met(t, r), read, 76).collect()} == {"perfect"}


def test_short_introns_move_like_deletions(spark, tmp_path):
    seqs = genome()
    tiles = sections.fasta_tiles(spark, write(tmp_path, "g.fa", fasta(seqs)), tile=64)
    t = sections.transcript_blocks(spark, write(tmp_path, "t.txt", block(1, "chrR", [(8, 40), (45, 90), (102, 300)])))
    got = sorted(map(tuple, sequence.indel_shifts(sequence.intron_indels(sections.short_introns(t)), tiles, 64).collect()))
    s = seqs["chrR"]
    assert got == sorted([("chrR", "D", 41, 4, *moves(s, 8, 90, 41, 4, s[40:44], "D")), ("chrR", "D", 91, 11, *moves(s, 45, 300, 91, 11, s[90:101], "D"))])


@pytest.mark.parametrize("line, error", [("chr1:1-90\t10\t-3\tNNN", "differs from the reference"), ("chr1:1-90\t10\t3\tAC", "do not fit"), ("chr1\t10\t3\tAC", "no region")])
def test_faulty_indels(spark, tmp_path, line, error):
    tiles = sections.fasta_tiles(spark, write(tmp_path, "g.fa", fasta(genome())))
    with pytest.raises(Exception, match=error):
        sequence.indel_shifts(sections.simulated_indels(spark, write(tmp_path, "i.txt", line + "\n")), tiles).collect()


def test_equal_indels_of_many_regions_are_followed_once(spark, tmp_path, monkeypatch):
    seqs = genome()
    tiles = sections.fasta_tiles(spark, write(tmp_path, "g.fa", fasta(seqs)), tile=64)
    s, asked = seqs["chrR"], []
    rows = [("chrR", low, high, 41 - low, -4, None) for low in (-3, 8, 30, 41) for high in (50, 90, 300)] + [("chrR", low, 300, 45 - low, 4, s[40:44]) for low in range(1, 40)] + [("chr?", 1, 90, 10, 2, "AC"), (None, 1, 90, 10, 2, "AC")]
    followed = sequence._extended
    monkeypatch.setattr(sequence, "_extended", lambda events, *x: asked.append(events.count()) or followed(events, *x))
    got = sequence.indel_shifts(spark.createDataFrame(rows, "chr string, s int, e int, pos int, size int, seq string"), tiles, 64).collect()
    want = [(c, "D" if n < 0 else "I", low + pos, abs(n), *(moves(s, max(low, 1), high, low + pos, abs(n), s[40:44], "D" if n < 0 else "I") if c == "chrR" else (0, 0))) for c, low, high, pos, n, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert asked == [8]  # two sides of four indels
