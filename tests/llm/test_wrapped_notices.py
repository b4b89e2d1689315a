"""License notices that are wrapped over several lines."""

import textwrap

from wardspan.llm import license_scan


def test_wrapped_notices(spark):
    """Wrapped or not, a notice has the same labels."""
    sets = [(label, set(license_scan.token_set(t))) for label, t in license_scan.TEMPLATES]
    rows, want = [], {}
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        x = set(license_scan.token_set(t))
        hit = [(label, u) for label, u in sets if len(x & u) >= license_scan.required(len(u), 80)]
        for width in (24, 40, 72):
            for j, (head, tail, mark) in enumerate((("", "", ""), ("Copyright of somebody. ", " More text follows here\n\nand goes on.", ""), ("", "", " * "), ("x\n\n", "\n\ny", "// "))):
                d = 1000 * k + 10 * width + j
                rows.append((d, "\n".join(mark + x for part in (head + t + tail).split("\n") for x in (textwrap.wrap(part, width) or [""]))))
                want[d] = {label for label, u in hit if not any(u < v for _, v in hit)}
    rows += [(90_000, "all\n" + "far apart\n" * 40 + "rights\n" + "far apart\n" * 40 + "reserved"), (90_001, "\n\n"), (90_002, "\nall rights\n\nreserved\n")]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [d for d in want if not want[d] <= set(got[d])] == []
    assert got[90_000] == got[90_001] == [""] and got[90_002] == ["all-rights-reserved"]
