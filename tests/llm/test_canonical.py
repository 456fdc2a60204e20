import random

from lithoflow.llm import canonical as c

REF = [(1, "GR", "Gamma Ray", "API"), (2, "SGR", "Spectral Gamma Ray", "API"), (3, "RHOB", "Bulk Density", "g/cm3"), (4, "NPHI", "Neutron Porosity", "v/v"), (5, "MSFL", "Microspherically Focused Log", "ohm.m"), (6, "CALI", "Caliper", "in"), (7, "PEF", "Photoelectric Factor", "b/e")]
SCHEMA = "ref_id bigint, code string, title string, common_unit string"
CURVES = "curve_id bigint, mnemonic string, name string, ref_id string, how int"


def brute_distance(a, b):
    """Plain Damerau-Levenshtein (optimal string alignment)."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_deletions_meet_within_two_edits():
    r = random.Random(1)
    word = "resistivity"
    for _ in range(200):
        t = list(word)
        for _ in range(2):
            k, i = r.choice("dis"), r.randrange(len(t) - 1)
            if k == "d":
                t.pop(i)
            elif k == "i":
                t.insert(i, r.choice("abxyz"))
            else:
                t[i] = r.choice("abxyz")
        assert c.deletions("".join(t)) & c.deletions(word)


def test_weights_stay_below_plain_distance():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abcde") for _ in range(r.randint(0, 7))) for _ in range(2))
        assert c.weighted_distance(a, b) <= brute_distance(a, b) + 1e-9
    assert c.weighted_distance("gmama", "gamma") == c.SWAP_COST and c.weighted_distance("abc", "abc") == 0


def test_entries():
    d = c.Dictionary.build([r[:3] for r in REF], {1: 10, 2: 5})
    cases = {
        ("LWD:GR", None): 1, ("G.R", ""): 1, ("gr final", "x"): 1, (" Gam_Ray (run 2)", None): 1, ("CRV_12", "GMAMA RAY log"): 1, ("", "sectral gama ray"): 2, ("blk dnsty", None): 3, ("Neutr porosty curve", None): 4,
        ("?", "Micro-spher. Foc. Log"): 5, ("calip", None): 6, ("CALLIPER", None): 6, ("photo-electric_factor", None): 7, ("PHOTOEL. FACTOR", None): 7, ("CCL", "Casing Collar Locator"): 0, ("UNK", "unknown curve"): 0,
        ("n/a", None): 0, (None, None): 0, ("", " "): 0, ("GR SGR", None): 0, ("x" * 5000, "y z " * 3000): 0, ("PUMP", "Pump Strokes"): 0,
    }
    assert {k: d.entry(*k)[0] for k in cases} == cases


def test_short_long_and_joined_words():
    long = "one two three four five seven eight nine eleven twelve"
    d = c.Dictionary.build([(1, "GR", "Gamma Ray"), (2, "BS", "Bit Size"), (3, "NPHI", "Neutron Porosity"), (4, "LG", long), (5, "CALI", "Caliper")], {1: 10})
    cases = {"Gamma Rya": 1, "Bti Size": 2, "Gamma Ry": 1, "GammaRay": 1, "GamaRay": 1, "NeutronPorosity log": 3, "Gam maRay": 1, long: 4, long.replace("five", "fi ve"): 4, "Ca li per": 5, "Gamma Log Xyz": 0, "Gamma Bit": 0, "GammaSize": 0, long + " more": 0}
    assert {k: d.entry(None, k)[0] for k in cases} == cases


def test_ties_go_to_the_more_used():
    entries = [(1, "AX", "Alpha Stone"), (2, "AY", "Alpha Stune")]
    assert c.Dictionary.build(entries, {2: 9}).entry("alpha stne", None)[0] == 2
    assert c.Dictionary.build(entries, {1: 9}).entry("alpha stne", None)[0] == 1
    assert c.Dictionary.build(entries, {}).entry("alpha stne", None)[0] == 1


def test_rows(spark):
    rows = [(1, "GR", None, "z", 1), (2, "gr", None, "z", 1), (2, "gr", None, "z", 1), (3, None, "bulk density", None, None), (4, "?", "?", None, None)]
    curves, ref = spark.createDataFrame(rows, CURVES), spark.createDataFrame(REF, SCHEMA)
    assert sorted(map(tuple, c.found(curves, ref).collect())) == [(2, 1), (3, 3), (4, 0)]
    assert [tuple(r) for r in c.misses(curves, ref).collect()] == [("?", "?", 1)]
    none, no_ref = spark.createDataFrame([], CURVES), spark.createDataFrame([], SCHEMA)
    assert c.found(none, ref).count() == 0 and {r.ref_id for r in c.found(curves, no_ref).collect()} == {0}


def test_slips_in_codes():
    d = c.Dictionary.build([r[:3] for r in REF], {1: 10, 2: 5})
    cases = {"GRR": 1, "RHBO": 3, "NPHII": 4, "CALLI": 6, "NPHA": 4, "PFE": 7, "CCL": 0, "PXF": 0, "GX": 0, "G": 0, "MSFX": 0}
    assert {k: d.entry(k, None)[0] for k in cases} == cases
    assert d.entry("GRR", "bulk density")[:2] == (3, "name title")  # a title counts before a slip


def test_use_counts_beside_cost():
    entries = [(1, "AX", "Alpha Stone"), (2, "AY", "Alpha Stong")]
    assert c.Dictionary.build(entries, {2: 100_000}).entry("alpha stonee", None)[0] == 1  # half an edit is more than any use
    assert c.Dictionary.build(entries, {2: 9}).entry("alpha stonx", None)[0] == 2


def test_many_titles_visit_few(monkeypatch):
    words = [a + b for a in ("ar", "bel", "cor", "dun", "eth") for b in ("ami", "osto", "ulek", "ithar", "emund")]
    entries = [(i, f"C{i}", f"{a} {b} {w}") for i, (a, b, w) in enumerate((a, b, w) for a in words[:10] for b in words[10:20] for w in words[20:])]
    d = c.Dictionary.build(entries, {})
    assert all(d.entry(None, t.upper().replace("AMI", "AIM"))[0] == i for i, _, t in entries[:200])
    assert max(map(len, d.places.values())) < len(entries) // 4


def test_a_long_list_is_taken_in_parts(spark, monkeypatch):
    typed = [(i, m, n, "z", 1) for i, (m, n) in enumerate([("LWD:GR", None), ("GR SGR", None), ("", "sectral gama ray"), ("blk dnsty", None), ("?", "Micro-spher. Foc. Log"), ("GRR", "?"), ("CCL", "Casing Collar Locator"), (None, None), ("GR NPHI", "Caliper"), ("PEF", "GR")])]
    curves, ref = spark.createDataFrame(typed * 2, CURVES), spark.createDataFrame(REF, SCHEMA)
    whole = sorted(map(tuple, c.map_curves(curves, ref).collect()), key=repr)
    monkeypatch.setattr(c, "PART", 2)
    assert len(list(c.dictionaries(curves, ref))) == 4
    assert sorted(map(tuple, c.map_curves(curves, ref).collect()), key=repr) == whole and len(whole) == 20
