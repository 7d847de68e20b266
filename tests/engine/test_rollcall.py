import random
from collections import defaultdict


from quorumlake.operators import rollcall as rc

ROSTER = [("B", "Anna Müller", "CDU"), ("B", "Karl Schütz", "SPD"), ("B", "Hans Schütz", "CDU"), ("B", "Eva Lang", "SPD")]
VOTES = [("1", "B", [("Müller", "ja"), ("Schütz, K.", "nein"), ("Lang", "ja")]), ("2", "B", [("Müller", "ja"), ("Lang", "abwesend"), ("Schütz", "ja")])]


def frames(spark, roster, votes):
    m = spark.createDataFrame(roster, "body_id string, name string, party_code string")
    e = spark.createDataFrame([(v, b, i, n, c) for v, b, roll in votes for i, (n, c) in enumerate(roll)], "vote_id string, body_id string, position int, name string, vote string")
    return m, e


def test_golden_scenario(spark):
    m, e = frames(spark, ROSTER, VOTES)
    a = rc.attribute(e, m)
    assert a.where("party is null").count() == 1
    lines = rc.party_lines(rc.party_counts(a))
    assert {(r.vote_id, r.party): r.line for r in lines.collect()} == {("1", "CDU"): "ja", ("1", "SPD"): "ja", ("2", "CDU"): "ja"}
    c = {r.party: r for r in rc.cohesion(lines).collect()}
    assert [(c[p].votes, c[p].members_cast, c[p].with_line, c[p].cohesion, c[p].attendance) for p in ("CDU", "SPD")] == [(2, 2, 2, 1.0, 1.0), (1, 2, 1, 0.5, 1.0)]
    assert [tuple(r) for r in rc.agreement(lines).collect()] == [("CDU", "SPD", 1, 1, 1.0)]
    assert [tuple(r) for r in rc.top_dissenters(rc.dissent(a, lines)).collect()] == [("Schütz, K.", "SPD", 1, 1)]
    v = spark.createDataFrame([(2, 1, 0, [1]), (1, 0, 0, [1]), (0, 0, 0, [])], "ja int, nein int, enthaltung int, members array<int>")
    assert tuple(rc.vote_totals(v).first()) == (3, 2, 1, 1)


def test_equals_a_plain_loop(spark):
    rng = random.Random(3)
    names = [f"{f} {l}" for f in ("Anna", "Bert", "Cora") for l in ("Adler", "Berg", "Christ", "Dorn")]
    roster = [(rng.choice("XY"), rng.choice(names), rng.choice(["P", "Q", "R", ""])) for _ in range(30)]
    roll = lambda: [(n.split()[1] + rng.choice(["", f", {n[0]}."]), rng.choice(["ja", "nein", "enthaltung", "abwesend", ""])) for n in rng.sample(names, 8)]
    votes = [(str(i), rng.choice("XYZ"), roll()) for i in range(60)]
    m, e = frames(spark, roster, votes)
    a = rc.attribute(e, m)

    def party(body, name):
        last, _, ini = name.partition(", ")
        ini = ini[:1].lower() or None
        own = {(n[0].lower(), p) for b, n, p in roster if p and b == body and n.split()[1] == last}
        found = own or {(n[0].lower(), p) for _, n, p in roster if p and n.split()[1] == last}
        if ini:
            found = {x for x in found if x[0] == ini} or found
        codes = {p for _, p in found}
        return codes.pop() if len(codes) == 1 else None

    want = sorted((v, i, str(party(b, n))) for v, b, roll in votes for i, (n, _) in enumerate(roll))
    assert sorted((r.vote_id, r.position, str(r.party)) for r in a.collect()) == want

    agg, pairs, dis = defaultdict(lambda: [0] * 4), defaultdict(list), defaultdict(lambda: [0, 0])
    for _, b, roll in votes:
        per, seen = defaultdict(lambda: defaultdict(int)), []
        for n, c in roll:
            if p := party(b, n):
                per[p][c or "abwesend"] += 1
                seen.append((n, p, c or "abwesend"))
        lines = {}
        for p, c in per.items():
            cast = {k: c[k] for k in rc.CAST}
            if sum(cast.values()):
                lines[p] = max(cast, key=cast.get)
                for k, x in enumerate((1, sum(cast.values()), cast[lines[p]], c["abwesend"])):
                    agg[p][k] += x
        for x in lines:
            for y in lines:
                if x < y:
                    pairs[x, y].append(lines[x] == lines[y])
        for n, p, c in seen:
            if c in rc.CAST and p in lines:
                dis[n][0] += c != lines[p]
                dis[n][1] += 1
    lines = rc.party_lines(rc.party_counts(a))
    assert {r.party: [r.votes, r.members_cast, r.with_line, r.abwesend] for r in rc.cohesion(lines).collect()} == dict(agg)
    assert {(r.a, r.b): (r.same, r.n) for r in rc.agreement(lines).collect()} == {k: (sum(x), len(x)) for k, x in pairs.items()}
    assert {r.name: [r.dissents, r.votes] for r in rc.dissent(a, lines).collect()} == {k: v for k, v in dis.items() if v[0]}


def test_person_votes(spark):
    m, e = frames(spark, ROSTER + [("C", "Eva Lang", "SPD")], [*VOTES, ("3", "Z", [("Lang", "nein"), ("Lang, E.", "ja")]), ("4", "B", [("Schütz, X.", "ja"), ("Schütz, K.", "nein"), ("Schütz, K.", "ja")])])
    votes = lambda n: {r.vote_id: r.vote for r in rc.person_votes(e, m, n).collect()}
    assert votes("Karl Schütz") == {"1": "nein", "4": "nein"}
    assert votes("Eva Lang") == {"1": "ja", "2": "abwesend", "3": "ja"}  # unique on B; on Z only the entry with an initial is clear
    assert votes("") == {} and votes("Nobody") == {}
