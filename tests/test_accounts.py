"""Accounts joined from what many tools say, without joining two security identifiers."""

from quarry.operators import accounts

SEEN = "tool string, domain string, name string, sid string, pid long, path string, event_id string, ordinal long"


def seen(spark, rows):
    return spark.createDataFrame([(t, d, n, s, p, None, e, i) for i, (t, d, n, s, p, e) in enumerate(rows)], SEEN)


def groups(df):
    return {r.account: (r.sid, set(r.names)) for r in accounts.accounts(df).collect()}


def test_aliases_join_around_one_sid(spark):
    df = seen(spark, [
        ("vol_getsids", "corp", "annabelle", "S-1-5-21-1", 10, None), ("parse_event_logs", "corp", "annabelle", None, None, "4672"), ("parse_event_logs", "", "annabelle", None, None, "4672"),
        ("vol_handles", "", "annabe~1", None, 66, None), ("vol_pstree", "", "lonely", None, 12, None), ("vol_pstree", "", "annabe~2", None, 13, None)])
    assert groups(df) == {"sid:S-1-5-21-1": ("S-1-5-21-1", {"corp\\annabelle", "annabelle", "annabe~1"}), "name:lonely": (None, {"lonely"}), "name:annabe~2": (None, {"annabe~2"})}
    made = {r.account: r for r in accounts.accounts(df).collect()}
    # the short name's process has no SID, so it isn't the account's
    assert (made["sid:S-1-5-21-1"].username, made["sid:S-1-5-21-1"].n_pids, made["sid:S-1-5-21-1"].n_privileged) == ("annabelle", 1, 2)
    assert made["name:lonely"].n_pids == 1 and made["sid:S-1-5-21-1"].source_tools == ["parse_event_logs", "vol_getsids", "vol_handles"]


def test_two_sids_never_join(spark):
    df = seen(spark, [
        # one name with two SIDs, and once with none
        ("vol_getsids", "corp", "shared", "S-1-5-21-1", 1, None), ("vol_getsids", "corp", "shared", "S-1-5-21-2", 2, None), ("parse_event_logs", "corp", "shared", None, None, None),
        # a name in two domains, and without one
        ("vol_getsids", "a", "twice", "S-1-5-21-3", 3, None), ("vol_getsids", "b", "twice", "S-1-5-21-4", 4, None), ("parse_event_logs", "", "twice", None, None, None),
        # a short name with a SID of its own; a name without domain with another than its domain's
        ("vol_getsids", "", "benjam~1", "S-1-5-21-5", 5, None), ("vol_getsids", "", "benjamin", "S-1-5-21-6", 6, None),
        ("vol_getsids", "", "clara", "S-1-5-21-7", 7, None), ("vol_getsids", "corp", "clara", "S-1-5-21-8", 8, None),
        # a long name without SID takes the one that its only short name has
        ("vol_getsids", "", "dominik~1", None, 9, None), ("vol_getsids", "", "domini~1", "S-1-5-21-9", 9, None), ("vol_pstree", "", "dominique", None, 11, None)])
    got = groups(df)
    assert all(r.seen_sid in (None, r.sid) for r in accounts.resolved(df).collect())
    assert got["sid:S-1-5-21-1"] == ("S-1-5-21-1", {"corp\\shared"}) and got["sid:S-1-5-21-2"] == ("S-1-5-21-2", {"corp\\shared"}) and got["name:corp\\shared"] == (None, {"corp\\shared"})
    assert got["name:twice"] == (None, {"twice"}) and got["sid:S-1-5-21-3"][1] == {"a\\twice"}
    assert got["sid:S-1-5-21-5"] == ("S-1-5-21-5", {"benjam~1"}) and got["sid:S-1-5-21-6"] == ("S-1-5-21-6", {"benjamin"})
    assert got["sid:S-1-5-21-7"] == ("S-1-5-21-7", {"clara"}) and got["sid:S-1-5-21-8"] == ("S-1-5-21-8", {"corp\\clara"})
    assert got["name:dominique"] == ("S-1-5-21-9", {"dominique", "domini~1"})


def test_ambiguous_short_names_stay(spark):
    df = seen(spark, [("t", "", "gabriele", None, 1, None), ("t", "", "gabriela", None, 2, None), ("t", "", "gabrie~1", None, 3, None)])
    assert groups(df) == {"name:gabriele": (None, {"gabriele"}), "name:gabriela": (None, {"gabriela"}), "name:gabrie~1": (None, {"gabrie~1"})}
    assert accounts.accounts(df.where("false")).count() == 0


def test_sources(spark):
    rows = spark.createDataFrame([(1, r"CORP\Ann", "x", 4), (2, "lab/Bob", "x", 5), (3, "SYSTEM", "x", 6), (4, "a b", "x", 7), (5, None, None, 8), (6, "-", "x", 9)], "id long, who string, other string, pid long")
    got = {(r.ordinal, r.domain, r.name) for r in accounts.in_fields(rows, "t", ["who"], "id").collect()}
    assert got == {(1, "corp", "ann"), (2, "lab", "bob")}
    paths = spark.createDataFrame([(1, r"C:\Users\Ann B\x.exe and c:\users\PUBLIC\y", r"D:\Users\Default\n"), (2, None, "none")], "id long, p string, q string")
    assert {r.name for r in accounts.in_paths(paths, "t", ["p", "q"], "id").collect()} == {"ann b", "public", "default"}
    assert {r.name for r in accounts.in_paths(paths, "t", ["p", "q"], "id", pseudo=False).collect()} == {"ann b"}
    told = spark.createDataFrame([(1, '<Data Name="TargetUserName">CORP\\eve</Data> New Account Name:\tmallory;', "4720")], "id long, m string, e string")
    assert {(r.domain, r.name, r.event_id) for r in accounts.in_messages(told, "t", "m", "id", told["e"]).collect()} == {("corp", "eve", "4720"), ("", "mallory", "4720")}


def test_strict_gate(spark):
    df = seen(spark, [("g", "", "ann", "S-1-5-21-1", 10, None), ("p", "", "bob", None, 10, None)] + [("parse_event_logs", "", "cat", None, None, "4672")] * 3 + [("s", "d", "dan", None, None, None)])
    bad, script = spark.createDataFrame([(10,)], "pid long"), spark.createDataFrame([("d", "dan")], "domain string, name string")
    got = {r.account: (r.passes, r.n_bad_pids) for r in accounts.strict(accounts.accounts(df), df, bad, script).collect()}
    assert got == {"sid:S-1-5-21-1": (True, 1), "name:bob": (False, 0), "name:cat": (True, 0), "name:d\\dan": (True, 0)}
