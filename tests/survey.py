"""A small random survey as plain rows, and the studies over it in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

COLUMNS = {
    "demographics": ["ridageyr", "riagendr", "ridreth3", "indfmpir"],
    "body_measures": ["bmxbmi"],
    "diabetes": ["diq010"],
    "bp_cholesterol_q": ["bpq020", "bpq080"],
    "insurance": ["hiq011"],
    "healthcare_util": ["huq010", "huq030", "huq042", "huq055", "huq090"],
    "medications": ["rxq033", "rxq050"],
    "weight_history": ["whq070"],
    "dietary_total_day1": ["drqsdiet"],
}
CODES = [1.0, 2.0, 3.0, 7.0, 9.0, None]
DOMAINS = {
    "ridageyr": [5.0, 17.0, 18.0, 25.0, 25.5, 26.0, 46.0, 55.0, 80.0, 81.0, None],
    "riagendr": [1.0, 2.0, None],
    "ridreth3": [1.0, 2.0, 3.0, 4.0, 6.0],
    "indfmpir": [0.0, 1.55, 5.0, None],
    "bmxbmi": [18.0, 25.0, 29.9, 29.95, 30.0, 41.5, None],
    "rxq050": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 9.0, None],
}


def random_survey(seed: int, people: int) -> dict[str, list[tuple]]:
    """Rows per table; a person is in each table but the first with chance 0.8."""
    rng = random.Random(seed)
    survey = {}
    for table, columns in COLUMNS.items():
        survey[table] = [
            (person, *[rng.choice(DOMAINS.get(c, CODES)) for c in columns])
            for person in range(people)
            if table == "demographics" or rng.random() < 0.8
        ]
    return survey


def schema(table: str) -> str:
    return "seqn bigint, " + ", ".join(f"{c} double" for c in COLUMNS[table])


def adults(survey: dict[str, list[tuple]]) -> list[dict]:
    found = {}
    for table, columns in COLUMNS.items():
        answers = {row[0]: dict(zip(columns, row[1:], strict=True)) for row in survey[table]}
        for row in survey["demographics"]:
            person = found.setdefault(row[0], {"seqn": row[0], "has": set()})
            person.update(answers.get(row[0], dict.fromkeys(columns)))
            if row[0] in answers:
                person["has"].add(table)
    return [p for p in found.values() if p["ridageyr"] is not None and p["ridageyr"] >= 18]


def rounded(value: float, places: int) -> float:
    step = Decimal(1).scaleb(-places)
    return float(Decimal(repr(value)).quantize(step, ROUND_HALF_UP))


def pct(part: int, whole: int) -> float | None:
    return rounded(100.0 * part / whole, 1) if whole else None


def avg(values) -> float | None:
    known = [v for v in values if v is not None]
    return rounded(sum(known) / len(known), 2) if known else None


def many(people, column, *codes) -> int:
    return sum(p[column] in codes for p in people)


def has(label: str, p: dict) -> bool:
    return {
        "Obesity": p["bmxbmi"] is not None and p["bmxbmi"] >= 30,
        "Diabetes": p["diq010"] in (1, 3),
        "Hypertension": p["bpq020"] == 1,
        "High Cholesterol": p["bpq080"] == 1,
    }[label]


def answered(label: str, p: dict) -> bool:
    return {
        "Obesity": p["bmxbmi"] is not None,
        "Diabetes": p["diq010"] in (1, 2, 3),
        "Hypertension": p["bpq020"] in (1, 2),
        "High Cholesterol": p["bpq080"] in (1, 2),
    }[label]


LABELS = ["Obesity", "Diabetes", "Hypertension", "High Cholesterol"]
LEVELS = [
    "0 - No conditions", "1 - Single condition", "2 - Two conditions",
    "3 - Three conditions", "4 - All four conditions",
]


def status(p: dict) -> str:
    return "Insured" if p["hiq011"] == 1 else "Uninsured"


def prevalence(people) -> list[tuple]:
    measured = [p for p in people if p["bmxbmi"] is not None]
    groups = [("All Adults (overall)", measured, measured)] + [
        ("Diabetes (incl. borderline)" if c == "Diabetes" else c,
         [p for p in people if has(c, p)], [p for p in people if answered(c, p)])
        for c in LABELS
    ]
    if not people:
        return [(label, None, None, None, None) for label, _, _ in groups]
    return [
        (label, len(yes), sum(status(p) == "Insured" for p in yes),
         sum(status(p) == "Uninsured" for p in yes), pct(len(yes), len(of)))
        for label, yes, of in groups
    ]


def access(people) -> list[tuple]:
    groups = defaultdict(list)
    for p in people:
        for label in ["Overall Respondents"] + [c for c in LABELS if has(c, p)]:
            groups[label != "Overall Respondents", label, status(p)].append(p)
    return [
        (label, insured, len(g), pct(many(g, "huq030", 2), len(g)),
         pct(many(g, "huq042", 3), len(g)), pct(many(g, "huq055", 1), len(g)),
         pct(many(g, "huq090", 1), len(g)), avg(p["huq010"] for p in g))
        for (_, label, insured), g in sorted(groups.items())
    ]


def by_count(people) -> list[tuple[str, list[dict]]]:
    groups = defaultdict(list)
    for p in people:
        if sum(answered(c, p) for c in LABELS) >= 3:
            groups[sum(has(c, p) for c in LABELS)].append(p)
    return [(LEVELS[n], g) for n, g in sorted(groups.items())]


def comorbidity(people) -> list[tuple]:
    return [
        (level, len(g), pct(many(g, "huq030", 2), len(g)), pct(many(g, "huq042", 3), len(g)),
         pct(many(g, "huq055", 1), len(g)), avg(p["huq010"] for p in g))
        for level, g in by_count(people)
    ]


def diet_interest(people) -> list[tuple]:
    bounds = [(18, 25), (26, 35), (36, 45), (46, 55), (56, 65), (66, 75), (76, 80)]

    def group(p):
        gender = {1.0: "Male", 2.0: "Female"}.get(p["riagendr"], "0")
        for low, high in bounds:
            if low <= p["ridageyr"] <= high:
                return gender, "76+" if low == 76 else f"{low}-{high}"
        return gender, "<18"

    def line(g):
        return tuple(
            pct(many(g, c, 1), sum(p[c] is not None for p in g))
            for c in ("whq070", "drqsdiet", "huq055")
        )

    groups = defaultdict(list)
    for p in people:
        groups[group(p)].append(p)
    return [(*k, *line(g)) for k, g in sorted(groups.items())] + [
        ("OVERALL", "OVERALL", *line(people))
    ]


def drugs(g) -> tuple:
    takers = [p for p in g if p["rxq033"] == 1]
    return len(g), pct(len(takers), len(g)), avg(p["rxq050"] for p in takers)


def at_least(g, n: int) -> float | None:
    return pct(sum(p["rxq050"] is not None and p["rxq050"] >= n for p in g), len(g))


def medication(people) -> list[tuple]:
    people = [p for p in people if p["rxq033"] in (1, 2)]
    groups = [("All Adults (overall)", [p for p in people if p["bmxbmi"] is not None])]
    groups += [(c, [p for p in people if has(c, p)]) for c in LABELS]
    return [(label, *drugs(g), at_least(g, 3)) for label, g in groups if g]


def prescriptions(people) -> list[tuple]:
    people = [p for p in people if p["rxq033"] in (1, 2)]
    return [
        (level, *drugs(g), at_least(g, 3), at_least(g, 5)) for level, g in by_count(people)
    ]
