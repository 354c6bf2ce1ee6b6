"""Rules that turn one row of aggregates into findings, worst first."""

from __future__ import annotations

import math

ORDER = {"fail": 0, "warn": 1, "info": 2}


def finding(level: str, name: str, text: str) -> dict:
    return {"level": level, "name": name, "text": text}


def chi_square_survival(x: float, dof: int) -> float:
    """P(X > x): the upper regularised gamma function at (dof/2, x/2), by series or continued fraction."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def classifier_findings(m: dict) -> list[dict]:
    """From teacher_f1, student_f1, gap_low, target, accuracy_at_80, teacher_accuracy, per_class, confidence, invalid_share, shift_p, shift_ratios; any may be absent."""
    out = []
    teacher, student = m.get("teacher_f1"), m.get("student_f1")
    if teacher is not None and teacher < m.get("target", 0.75):
        out.append(finding("fail", "teacher bottleneck", f"the teacher scores {teacher:.3f}; no student can be expected to be better"))
    if teacher is not None and student is not None and teacher - student > 0.05:
        sure = m.get("gap_low", 0) > 0
        out.append(finding("fail" if sure else "warn", "student gap", f"the student is {teacher - student:.3f} behind" + ("" if sure else ", within the interval")))
    if m.get("accuracy_at_80") is not None and m.get("teacher_accuracy") is not None and m["accuracy_at_80"] >= m["teacher_accuracy"]:
        out.append(finding("info", "selective parity", "on its surest four fifths the student is as good as the teacher"))
    for label, c in sorted(m.get("per_class", {}).items()):
        if teacher is not None and student is not None and c.get("teacher_f1", 1) < teacher - 0.15 and c.get("student_f1", 1) < student - 0.15:
            out.append(finding("warn", "ambiguous label", f"{label} is hard for both"))
        if c.get("support", 20) < 20:
            out.append(finding("warn", "thin class", f"{label} has {c['support']} test rows"))
    if m.get("confidence") is not None and m["confidence"] < 0.7:
        out.append(finding("warn", "unsure teacher", f"mean confidence {m['confidence']:.2f}"))
    if m.get("shift_p") is not None and m["shift_p"] < 0.01 and any(not 0.5 <= r <= 2 for r in m.get("shift_ratios", [])):
        out.append(finding("warn", "shift", "label shares of the pool differ from the seed's"))
    if m.get("invalid_share", 0) > 0.05:
        out.append(finding("warn", "invalid answers", f"{m['invalid_share']:.1%} of the pool has no valid label"))
    return sorted(out, key=lambda f: ORDER[f["level"]])


def panel_findings(metrics: dict[str, dict]) -> list[dict]:
    """From each question's minority, auroc, resolution_share, ece, overconfidence, teacher_ece."""
    out = []
    for q, m in sorted(metrics.items()):
        if m.get("minority") is not None and m["minority"] < 12:
            out.append(finding("warn", "lopsided", f"{q}: {m['minority']} rows of the rarer answer; nothing else can be said"))
            continue
        if m.get("auroc") is not None and m["auroc"] < 0.6:
            out.append(finding("fail", "no signal", f"{q}: AUROC {m['auroc']:.2f}"))
        if m.get("resolution_share") is not None and m["resolution_share"] < 0.03:
            out.append(finding("warn", "flat", f"{q}: the answers explain {m['resolution_share']:.1%} of the uncertainty"))
        if m.get("ece") is not None and m["ece"] > 0.10:
            out.append(finding("warn", "miscalibrated", f"{q}: {'over' if m.get('overconfidence', 0) > 0 else 'under'}confident, ECE {m['ece']:.2f}"))
        if m.get("teacher_ece") is not None and m["teacher_ece"] > 0.10:
            out.append(finding("warn", "teacher miscalibrated", f"{q}: teacher ECE {m['teacher_ece']:.2f}"))
    return sorted(out, key=lambda f: ORDER[f["level"]])


def report(findings: list[dict], metrics: dict) -> str:
    """A plain text report."""
    lines = [f"{k:>24}  {v:.4f}" if isinstance(v, float) else f"{k:>24}  {v}" for k, v in metrics.items() if not isinstance(v, (dict, list))]
    return "\n".join([*lines, "", *(f"[{f['level']}] {f['name']}: {f['text']}" for f in findings)])
