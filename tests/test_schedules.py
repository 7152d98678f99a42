from tracelake.sources.schedules import relations

REPORT = """=== Generated schedule for mkTop ===
Method: get
Sequenced before: put, RL_step
Conflict-free: (none)
Rule: step
Sequenced after: get
Conflicts: step drain
Logical execution order: a, b, c
a C b
b CF c
x: CF [y, z]; SB w
rule p conflicts with q.
p must execute before r
p is conflict-free with q
a CONFLICT-FREE b
c: SEQUENTIAL-BEFORE d
c SEQUENTIAL-BEFORE-REVERSE e
c: EXECUTION-ORDER [f, g]
Execution order:
1. m -> n
"""


def test_every_form_of_line(spark):
    got = {(r["module"], r["src"], r["dst"], r["kind"]) for r in relations(spark.createDataFrame([("f", REPORT)], "report string, value string")).collect()}
    want = {
        ("get", "put", "sequential-before"), ("get", "step", "sequential-before"), ("step", "drain", "conflict"),
        ("a", "b", "execution-order"), ("b", "c", "execution-order"), ("a", "b", "conflict"), ("b", "c", "conflict-free"),
        ("x", "y", "conflict-free"), ("x", "z", "conflict-free"), ("x", "w", "sequential-before"), ("p", "q", "conflict"),
        ("a", "b", "conflict-free"), ("c", "d", "sequential-before"), ("c", "e", "sequential-before-reverse"), ("c", "f", "execution-order"), ("c", "g", "execution-order"),
        ("p", "r", "execution-order"), ("p", "q", "conflict-free"), ("m", "n", "execution-order"),
    }
    assert {x[1:] for x in got} == want
    assert {x[0] for x in got} == {"mkTop"}


def test_an_empty_report_has_no_relations(spark):
    assert relations(spark.createDataFrame([("f", "")], "report string, value string")).count() == 0
