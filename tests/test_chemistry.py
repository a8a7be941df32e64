"""Molecules: spellings of one molecule, invalid strings, isomorphism and paths by brute force."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import chemistry, molecules, named, scoring, text
from tessera.operators import curate

SPELLINGS = [
    ("OCC", "CCO"),
    ("C1=CC=CC=C1", "c1ccccc1"),
    ("CN(=O)=O", "C[N+](=O)[O-]"),
    ("c1ccc2ccccc2c1", "C1=CC2=CC=CC=C2C=C1"),
    ("[H]C([H])([H])O", "CO"),
    ("N[C@@H](C)C(=O)O", "C[C@H](N)C(=O)O"),
    ("C[C@](C)(F)Cl", "CC(C)(F)Cl"),
    ("c1cc[nH]c1", "C1=CNC=C1"),
    ("O=c1cc[nH]cc1", "O=C1C=CNC=C1"),
    ("c1ccccc1c1ccccc1", "c1ccc(cc1)-c1ccccc1"),
    ("[Na+].[Cl-]", "[Cl-].[Na+]"),
    ("C[C@H]1CC[C@@H](C)CC1", "C[C@@H]1CC[C@H](C)CC1"),
    ("CC1=C2C=CC=CC=C2C=C1", "Cc1ccc2cccccc1-2"),
    ("C%12CC%12", "C1CC1"),
    ("F/C=C/F", "FC=CF"),
    ("C[S@](=O)CC", "CC[S@@](=O)C"),
    ("[CH3][CH2][OH]", "CCO"),
    ("c1ccn(=O)cc1", "[O-][n+]1ccccc1"),
    ("CCO ethanol", "OCC"),
]
OTHERS = [("N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O"), ("C[C@H]1CC[C@@H](C)CC1", "C[C@H]1CC[C@H](C)CC1"), ("CCO", "COC"), ("C[C@H](O)[C@@H](O)C", "C[C@H](O)[C@H](O)C"), ("C[S@](=O)CC", "C[S@@](=O)CC"), ("[13CH4]", "C"), ("C[O-]", "CO"), ("[1*]C", "[2*]C"), ("C1CCC1", "CC=CC"), ("[CH3]", "C")]
INVALID = ["", " ", "C1CC", "C(", "C)", "c1cccc1", "F(C)C", "CC(C)(C)(C)C", "[Xx]", "C=", "=C", "cc", "C()C", "c1ccnc1", "(C)", "C11", "C12CC12", "C..", "é", "C\x00", "[C", "C=1CC-1", "N(C)(C)(C)C", "O(C)(C)C", "[12]", "1CC1", "C.(C)"]
MOLECULES = """CC(=O)Oc1ccccc1C(=O)O CN1C=NC2=C1C(=O)N(C(=O)N2C)C OC[C@H]1O[C@@H](O)[C@H](O)[C@@H](O)[C@@H]1O
CN1CC[C@]23[C@@H]4[C@H]1CC5=C2C(=C(C=C5)O)O[C@H]3[C@H](C=C4)O C[C@]12CC[C@H]3[C@H]([C@@H]1CC[C@@H]2O)CCC4=CC(=O)CC[C@]34C c1ccc2c(c1)[nH]c1ccccc12
O=c1[nH]c(=O)c2[nH]cnc2[nH]1 FC(F)(F)c1ccc(cc1)C(C)(C)C C12C3C4C1C5C2C3C45 [13CH3]C(=O)[O-].[Na+] [1*]C([2*])=C1CCCC1 O=S(=O)(N)c1ccc(Cl)cc1 C1=CC=C2C=CC=CC2=C1
C1CCC2(CC1)CCCCC2 CP(=O)(O)O C#CC#N [Fe+2].[Cl-].[Cl-] C[C@H](O)[C@@H](O)[C@H](O)C c1cc[se]c1 C[N+](C)(C)CC[O-] Cn1nnnc1 O=C1C=CC(=O)C=C1 [CH-]1C=CC=C1 C[S@](=O)c1ccccc1""".split()


def form(s):
    return chemistry.described(s)[1]


@pytest.mark.parametrize(("a", "b"), SPELLINGS)
def test_one_string_for_spellings(a, b):
    assert form(a) == form(b) is not None
    assert form(form(a)) == form(a)


@pytest.mark.parametrize(("a", "b"), OTHERS)
def test_different_molecules(a, b):
    assert None not in (form(a), form(b)) and form(a) != form(b)


@pytest.mark.parametrize("s", INVALID)
def test_invalid(s):
    assert chemistry.described(s) == (False, None, None, False, None, None)


def spelled(m, r):
    """A spelling from random starts in random order, with the marks of its centres."""
    order = list(range(len(m.atoms)))
    r.shuffle(order)
    place = {a: k for k, a in enumerate(order)}
    parts, seen = [], set()
    for start in order:
        part, todo = {}, [start]
        while todo:
            if (a := todo.pop()) not in seen:
                seen.add(a)
                part[a] = place[a]
                todo += m.bonds[a]
        if part:
            parts.append(chemistry._string(m, part, {a for a in part if m.atoms[a].mark and len(m.atoms[a].order) == 4}))
    return ".".join(parts)


@pytest.mark.parametrize("s", MOLECULES)
def test_random_spellings(s):
    r, m = random.Random(1), chemistry.read(s)
    assert {form(spelled(m, r)) for _ in range(30)} == {form(s)}
    plain = chemistry.written(m, chiral=False)
    assert "@" not in plain and {chemistry.described(spelled(m, r))[4] for _ in range(10)} == {plain}


def random_molecule(r):
    room = {"C": 4, "N": 3, "O": 2, "S": 2, "F": 1}
    while True:
        names = [r.choice("CCCNOSF") for _ in range(r.randrange(2, 7))]
        left, bonds = [room[x] for x in names], [{} for _ in names]
        tree = [(r.randrange(a), a) for a in range(1, len(names))]
        for a, b in tree + [sorted(r.sample(range(len(names)), 2)) for _ in range(r.randrange(4))]:
            if left[a] and left[b] and bonds[a].get(b, 0) < 3:
                bonds[a][b] = bonds[b][a] = bonds[a].get(b, 0) + 1
                left[a], left[b] = left[a] - 1, left[b] - 1
        m = chemistry.Molecule([chemistry.Atom(x) for x in names], bonds)
        if all(bonds):
            return chemistry.read(spelled(with_hydrogens(m), r))


def with_hydrogens(m):
    chemistry._with_double_bonds(m, chemistry.ring_bonds(m.bonds))
    return m


def isomorphic(m, other):
    n = len(m.atoms)
    same = lambda a, b: (a.symbol, a.aromatic, a.hydrogens) == (b.symbol, b.aromatic, b.hydrogens)
    return any(all(same(m.atoms[a], other.atoms[p[a]]) and {p[b]: o for b, o in m.bonds[a].items()} == other.bonds[p[a]] for a in range(n)) for p in itertools.permutations(range(n)))


def test_equal_if_and_only_if_isomorphic():
    r = random.Random(7)
    found = [random_molecule(r) for _ in range(150)]
    strings = [chemistry.written(m) for m in found]
    for (a, x), (b, y) in itertools.combinations(zip(found, strings), 2):
        if sorted(i.symbol for i in a.atoms) != sorted(i.symbol for i in b.atoms):
            assert x != y
        else:
            assert (x == y) == isomorphic(a, b)


def plain_paths(m, most):
    """All sequences of different atoms, kept where each two are bonded."""
    sign = {1: "-", 2: "=", 3: "#", 1.5: ":"}
    name = lambda a: a.symbol.lower() if a.aromatic else a.symbol
    out = set()
    for n in range(2, most + 2):
        for p in itertools.permutations(range(len(m.atoms)), n):
            if all(b in m.bonds[a] for a, b in zip(p, p[1:])):
                shown = [name(m.atoms[p[0]])]
                for a, b in zip(p, p[1:]):
                    shown += [sign[m.bonds[a][b]], name(m.atoms[b])]
                out.add(min("".join(shown), "".join(shown[::-1])))
    return out


@pytest.mark.parametrize("s", ["CC(=O)N", "c1ccncc1", "C1CC1C#N", "C", "BrC(Cl)=C", "C1CC2CC12", "Clc1ccccc1"])
def test_paths(s):
    m = chemistry.read(s)
    want = plain_paths(m, 7)
    assert chemistry.paths(m) == want
    digest = lambda p, k: int(hashlib.md5(p.encode()).hexdigest()[k : k + 4], 16) % 2048
    assert chemistry.bits(want) == sorted({digest(p, k) for p in want for k in (0, 4)})
    assert max(p.count("-") + p.count("=") + p.count(":") for p in chemistry.paths(chemistry.read("C" * 20))) == 7


def test_ring_bonds():
    r = random.Random(2)
    for _ in range(60):
        n = r.randrange(2, 9)
        bonds = [{} for _ in range(n)]
        for a, b in itertools.combinations(range(n), 2):
            if r.random() < 0.35:
                bonds[a][b] = bonds[b][a] = 1

        def reaches(a, b):
            seen, todo = set(), [a]
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += [y for y in bonds[x] if {x, y} != {a, b}]
            return b in seen

        assert chemistry.ring_bonds(bonds) == {(a, b) for a in range(n) for b in bonds[a] if a < b and reaches(a, b)}


def test_largest_matching():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(2, 9)
        edges = [e for e in itertools.combinations(range(n), 2) if r.random() < 0.4]
        mate = chemistry._matching({a: [y if x == a else x for x, y in edges if a in (x, y)] for a in range(n)})
        assert all(mate[mate[a]] == a and tuple(sorted((a, mate[a]))) in edges for a in mate)
        best = max(k for k in range(n // 2 + 1) for es in itertools.combinations(edges, k) if len({x for e in es for x in e}) == 2 * k)
        assert len(mate) == 2 * best


def test_long_and_repetitive_strings():
    assert form("C" * 4000) == form("C(" + "C" * 2000 + ")" + "C" * 1999) is not None
    assert form("C" * 4000 + "(") is None
    assert form("C." * 500 + "C") == ".".join(["C"] * 501)
    assert form("c1ccccc1" * 60) is not None
    assert form("CC(C)(C)" * 40) == form(spelled(chemistry.read("CC(C)(C)" * 40), random.Random(5)))
    assert form("c" * 600) is None and form("C(" * 600) is None


def test_described_on_spark(spark):
    b = molecules.Graph()
    rows = [("OCC", "CCO"), ("N[C@@H](C)O", "N[C@H](C)O"), ("C(", "CC"), (None, "CC"), ("C", "[CH4]"), ("F/C=C/F", "F/C=C\\F")]
    df = spark.createDataFrame(rows, "g string, p string").select(b.described(F.col("g")).alias("g"), b.described(F.col("p")).alias("p"))
    got = df.select(*[v.alias(k) for k, v in scoring.components(F.col("g"), F.col("p"), 0.25).items()]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 1, 0.25, 0), (1, 1, 0, 1, 0, 0), (1, 0, 0, 0, 0.25, 0), (1, 0, 0, 0, 0.25, 0), (1, 1, 1, 1, 0.25, 0), (1, 1, 1, 1, 0.25, 0)]
    both = df.select(molecules.canonical_for_evaluation(F.col("g")).alias("e"), molecules.canonical_for_reward(F.col("g")).alias("r")).collect()
    assert (both[2].e, both[2].r) == ("C(", text.EMPTY) and both[0].e == both[0].r == form("CCO")


LABELS = {"[R12]": "[12*]", "[R]": "*", "[Ph]": "*", "[OMe]": "*", "[13CH3-]": "[13CH3-]", "[nH]": "[nH]", "[C@@H]": "[C@@H]", "[Fe+3]": "[Fe+3]", "[O--]": "[O--]", "[Xx]": "*", "[se]": "[se]", "[CH3:7]": "[CH3:7]", "[H+]": "[H+]", "[R1a]": "*", "[12]": "*", "[*]": "[*]", "[3*]": "[3*]"}


def test_group_labels(spark):
    df = spark.createDataFrame([(k, v) for k, v in LABELS.items()], "given string, want string")
    for r in df.select("given", "want", molecules.group_labels(F.concat(F.lit("CC"), "given", F.lit("C(=O)Cl"))).alias("got")).collect():
        assert r.got == f"CC{r.want}C(=O)Cl", r.given


def test_reward_by_name(spark):
    golds = ["CCO", "N[C@@H](C)C(=O)O", '{"ground_truth": "OCC"}', '{"x": 1}', "[1, 2]", "", None, "C(", '"CCO"', '{"ground_truth": null}']
    said = ["OCC", " \n\t\n C C O \r\nrest", "C[C@H](N)C(=O)O", "N[C@H](C)C(=O)O", "", None, "C(", "C" * 40, "ab" * 30, "CC\u2028N", "x\x1cCCO", "it's \\ a 'text'", "abc" * 5 + "C" * 20]
    df = spark.createDataFrame([(g, p) for g in golds for p in said], "g string, p string")
    for options in ({}, {"unannotated": 0.25, "clamp": False, "weights": scoring.CURATION_WEIGHTS}, {"weights": scoring.Weights(0, 0, 0, 0, 0, 1)}):
        named.register(spark, **options)
        w = options.get("weights", scoring.RL_WEIGHTS)
        b = molecules.Graph()
        pair = df.select("g", "p", b.described(text.ground_truth(F.col("g"))).alias("gold"), b.described(text.candidate_first_text(F.col("p"))).alias("pred"))
        want = pair.select("g", "p", scoring.reward(scoring.components(F.col("gold"), F.col("pred"), options.get("unannotated", 0.0)), w, options.get("clamp", True)).alias("want"))
        got = spark.sql("SELECT g, p, compute_score('a', p, g) AS got FROM {df}", df=df)
        rows = {(r.g, r.p): r.got for r in got.collect()}
        assert rows == {(r.g, r.p): pytest.approx(r.want) for r in want.collect()}
    named.register(spark)
    assert spark.sql("SELECT compute_score('a', 'OCC', 'CCO', '{}') AS x").first().x == pytest.approx(7.5 / 8.5)
    score = df.select("g", "p", curate.compute_score(None, F.col("p"), F.col("g"), backend=molecules.Graph()).alias("x"))
    assert {(r.g, r.p): r.x for r in score.collect()} == {(r.g, r.p): pytest.approx(r.x) for r in spark.sql("SELECT g, p, compute_score(null, p, g) AS x FROM {df}", df=df).collect()}


def test_kept_fingerprints_are_small():
    """A worker's memory doesn't grow with its rows: answers take two bytes a number, and few are kept."""
    found = chemistry.described("CCN(C)C(=O)O" * 20)
    assert found[2].itemsize == 2 and found[2].tolist() == chemistry.bits(chemistry.paths(chemistry.read("CCN(C)C(=O)O" * 20)))
    assert chemistry._KEPT * max(2 * 2 * 2048, 4 * chemistry._LONGEST) < 1 << 27


def test_tasks_of_costly_work_are_bounded(spark, monkeypatch):
    from tessera import session

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    df = spark.range(1000).selectExpr("id", "id % 300 as k")
    sizes = session.spread(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 20 and sum(sizes) == 1000 and max(sizes) <= 70
    met = session.spread(df, "k", rows=1000).rdd.mapPartitionsWithIndex(lambda at, rows: {(r.k, at) for r in rows}).collect()
    assert len(met) == 300 and len({at for _, at in met}) > 10
    assert session.spread(df.limit(3)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_canonical_alone():
    for s in ("OCC", "N[C@@H](C)O", "C(", "", "F/C=C/F name", "c1ccccc1"):
        assert chemistry.canonical(s) == chemistry.described(s)[:2]


def test_canonical_forms_draws_no_fingerprints(spark, monkeypatch):
    from tessera.plans import catalogue

    class Forms(molecules.Graph):
        def described(self, c):
            raise AssertionError("only forms are needed")

    monkeypatch.setattr(catalogue, "BACKEND", Forms())
    for name in ("canonical_forms", "ring_spellings"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("name", ["reward_reft", "compute_score_by_name"])
def test_rewards_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch, name):
    from tessera import session
    from tessera.plans import catalogue

    whole = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(session, "TASK_ROWS", 5)
    got = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() == max(4, -(-len(whole) // 5))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole))


def test_curation_is_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    from tessera import session
    from tessera.plans import catalogue

    d, dealt, best = "/root/testdata/sf0.001", [], curate.best
    whole = catalogue.curation_funnel(spark, d).collect()
    replies = spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'assistant'").count()
    monkeypatch.setattr(session, "TASK_ROWS", 5, raising=False)
    monkeypatch.setattr(curate, "best", lambda rows, *rest: dealt.append(rows.rdd.getNumPartitions()) or best(rows, *rest))
    assert catalogue.curation_funnel(spark, d).collect() == whole
    assert dealt == [-(-replies // 5)] and dealt[0] > spark.sparkContext.defaultParallelism
