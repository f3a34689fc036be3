import random

import pytest

from allelio.operators.normalise import normalise


def brute(seq, pos, ref, alt):
    """Base by base: shorten at the end, extend at the front, then shorten at the front."""
    while ref != alt:
        if ref[-1] == alt[-1] and min(len(ref), len(alt)) > 1:
            ref, alt = ref[:-1], alt[:-1]
        elif ref[-1] == alt[-1] and pos > 1:
            ref, alt, pos = seq[pos - 2] + ref[:-1], seq[pos - 2] + alt[:-1], pos - 1
        elif ref[0] == alt[0] and min(len(ref), len(alt)) > 1:
            ref, alt, pos = ref[1:], alt[1:], pos + 1
        else:
            break
    return pos, ref, alt


def genome_of(spark, contigs, chunk):
    rows = [(c, i // chunk, s[i : i + chunk]) for c, s in contigs.items() for i in range(0, len(s), chunk)]
    return spark.createDataFrame(rows, "contig string, chunk_no bigint, seq string")


def run(spark, contigs, variants, chunk):
    rows = [(i, *v) for i, v in enumerate(variants)]
    df = spark.createDataFrame(rows, "row_id int, contig string, pos bigint, ref string, alt string")
    out = normalise(df, genome_of(spark, contigs, chunk), chunk)
    assert out.columns == df.columns
    return {r.row_id: (r.pos, r.ref, r.alt) for r in out.collect()}


@pytest.mark.parametrize("chunk, alphabet", [(10, "AC"), (25, "ACGT"), (1000, "A")])
def test_random_variants(spark, chunk, alphabet):
    rng = random.Random(chunk)
    contigs = {c: "".join(rng.choice(alphabet) for _ in range(200)) for c in ("c1", "c2")}
    variants = []
    for _ in range(300):
        c = rng.choice(list(contigs))
        pos = rng.randint(1, 190)
        ref = contigs[c][pos - 1 : pos - 1 + rng.randint(1, 6)]
        kind = rng.random()
        if kind < 0.4:
            alt = ref + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))
        elif kind < 0.7:
            alt = ref[: rng.randint(1, len(ref))]
        elif kind < 0.85:
            alt = ref[rng.randrange(len(ref)) :]
        else:
            alt = "".join(rng.choice("ACGT") for _ in ref)
        variants.append((c, pos, ref, alt))
    got = run(spark, contigs, variants, chunk)
    assert len(got) == len(variants)
    for i, (c, pos, ref, alt) in enumerate(variants):
        want = brute(contigs[c], pos, ref, alt)
        if want[0] == 1 or got[i][0] == 1:
            continue  # at the first base of a contig there is no base in front to anchor on
        assert got[i] == want, (variants[i], contigs[c])


def test_long_run_over_many_chunks(spark):
    seq = "GC" + "A" * 120 + "T"
    got = run(spark, {"c": seq}, [("c", 122, "A", "AA"), ("c", 120, "AAA", "A"), ("c", 50, "A", "G")], 10)
    assert got == {0: (2, "C", "CA"), 1: (2, "CAA", "C"), 2: (50, "A", "G")}


def test_a_run_is_followed_in_few_turns(spark, monkeypatch):
    from allelio.operators import normalise as module

    turns, windows = [], module.genome_windows
    monkeypatch.setattr(module, "genome_windows", lambda genome, places, back: turns.append(back) or windows(genome, places, back))
    seq = "GC" + "ACA" * 300 + "T"
    got = run(spark, {"c": seq, "d": "T" * 50}, [("c", 900, "ACA", "ACAACA"), ("c", 899, "AACA", "A"), ("d", 9, "T", "TT")], 10)
    assert got == {i: brute(seq, *v) for i, v in enumerate([(900, "ACA", "ACAACA"), (899, "AACA", "A")])} | {2: got[2]}
    assert got[2][0] <= 2
    assert turns == [1, 2, 4, 8, 16, 32, 64]  # 90 chunks


def test_a_genome_with_gaps(spark):
    seq = "GC" + "A" * 60 + "T"
    rows = [("c", i // 10, seq[i : i + 10]) for i in range(0, len(seq), 10) if i // 10 != 3]
    df = spark.createDataFrame([(0, "c", 60, "A", "AA"), (1, "c", 35, "A", "AA"), (2, "c", 25, "A", "AA")], "row_id int, contig string, pos bigint, ref string, alt string")
    out = {r.row_id: (r.pos, r.ref, r.alt) for r in normalise(df, spark.createDataFrame(rows, "contig string, chunk_no bigint, seq string"), 10).collect()}
    # The run of the first ends where the genome table does, the second's place is not in it.
    assert out == {0: (41, "A", "AA"), 1: (35, "A", "AA"), 2: (2, "C", "CA")}


def test_contig_start(spark):
    got = run(spark, {"c": "AAAAT"}, [("c", 3, "AA", "A"), ("c", 1, "AA", "A")], 10)
    assert got[0] == (1, "AA", "A")
    assert got[1] == (1, "AA", "A")


def test_idempotent_and_others_untouched(spark):
    seq = "GATTACAGATTACAGGGGT"
    variants = [("c", 18, "G", "GG"), ("c", 5, "ACAG", "<DEL>"), ("c", 5, "A", "*"), ("other", 5, "AA", "A"), ("c", 3, "TTA", "TCA")]
    once = run(spark, {"c": seq}, variants, 10)
    assert once[0] == (14, "A", "AG")
    assert once[1] == (5, "ACAG", "<DEL>") and once[2] == (5, "A", "*")
    assert once[3] == (5, "AA", "A")  # its contig is not in the genome
    assert once[4] == (4, "T", "C")
    again = run(spark, {"c": seq}, [(v[0], *once[i]) for i, v in enumerate(variants)], 10)
    assert again == once
