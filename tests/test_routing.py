"""Findings routed to benign, case by case."""

from quarry.operators import routing

SHAPE = "finding_id long, title string, description string, raw_excerpt string, claims array<map<string,string>>, verdict string, false_positive boolean, signals array<string>"


def test_routing(spark):
    def finding(i, text, verdict=None, pid=None, signals=(), wrong=None):
        return (i, text, None, None, [{"type": "pid", "pid": pid}] if pid else None, verdict, wrong, list(signals))

    rows = [
        finding(1, "socket at 127.0.0.1", "benign"), finding(2, "socket at localhost and 8.8.8.8", "benign"), finding(3, "socket at ::1, 10.0.0.9", "likely_fp"), finding(4, "judged", "confirmed_benign", "40"),
        finding(5, "same process", pid="40"), finding(6, "pid=40 to 8.8.4.4"), finding(7, "PID 40 to 192.168.0.1"), finding(8, "pid 40", "malicious"), finding(9, "pid 40", signals=["dga_domain"]), finding(10, "pid 40", signals=["rwx_memory_region_with_unusual_protection"]),
        finding(11, "other", pid="41"), finding(12, "zero", "benign", "0"), finding(13, "zero", pid="0"), finding(14, "localhost", wrong=True), finding(15, "pid 40 at 300.1.1.1"), finding(16, "localhost", "benign", signals=["dga_domain"])]
    got = {r.finding_id: r.reason for r in routing.routed(spark.createDataFrame(rows, SHAPE)).collect()}
    want = dict.fromkeys(range(1, 17)) | {1: "loopback_benign", 14: "loopback_benign"} | dict.fromkeys((5, 7, 10, 15), "entity_benign_propagation")
    assert got == want
    assert routing.routed(spark.createDataFrame(rows, SHAPE).where("false")).count() == 0
