"""Answer codes: which ones count as an answer, which ones as a yes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwise.functions.flags import flag


@dataclass(frozen=True)
class CodeSet:
    """A coded question: `valid` codes are answers, `positive` codes mean yes.

    Refused and don't-know codes are in neither set, so they drop out of both
    sides of a percentage that is taken over valid answers.
    """

    column: str
    valid: tuple[int, ...]
    positive: tuple[int, ...]

    def answered(self) -> Column:
        return F.col(self.column).isin(*self.valid)

    def present(self) -> Column:
        return F.col(self.column).isin(*self.positive)


@dataclass(frozen=True)
class Threshold:
    """A measured value: any value is an answer, `at_least` or more means yes."""

    column: str
    at_least: float

    def answered(self) -> Column:
        return F.col(self.column).isNotNull()

    def present(self) -> Column:
        return F.col(self.column) >= self.at_least


def answered_flag(question: CodeSet | Threshold) -> Column:
    """1 when the respondent gave a usable answer, else 0 (never null)."""
    return flag(question.answered())


def present_flag(question: CodeSet | Threshold) -> Column:
    """1 when the answer is a yes, else 0; a missing answer is a 0."""
    return flag(question.present())


def confirmed_flag(question: CodeSet | Threshold) -> Column:
    """1 when the answer is both usable and a yes."""
    return flag(question.answered() & question.present())


# Answer codes and cut-offs.
OBESITY = Threshold("bmxbmi", 30)
DIABETES = CodeSet("diq010", valid=(1, 2, 3), positive=(1, 3))
HYPERTENSION = CodeSet("bpq020", valid=(1, 2), positive=(1,))
HIGH_CHOLESTEROL = CodeSet("bpq080", valid=(1, 2), positive=(1,))
PRESCRIPTION = CodeSet("rxq033", valid=(1, 2), positive=(1,))
OVERWEIGHT_RANGE = (25, 29.9)
ADULT_AGE = 18
ENOUGH_ANSWERS = 3
GENDERS = {1: "Male", 2: "Female"}
OTHER_GENDER = "0"
AGE_BINS = (
    (18, 25, "18-25"),
    (26, 35, "26-35"),
    (36, 45, "36-45"),
    (46, 55, "46-55"),
    (56, 65, "56-65"),
    (66, 75, "66-75"),
    (76, 80, "76+"),
)
OTHER_AGE = "<18"
COMORBIDITY_LEVELS = {
    0: "0 - No conditions",
    1: "1 - Single condition",
    2: "2 - Two conditions",
    3: "3 - Three conditions",
    4: "4 - All four conditions",
}

CONDITIONS = {
    "Obesity": OBESITY,
    "Diabetes": DIABETES,
    "Hypertension": HYPERTENSION,
    "High Cholesterol": HIGH_CHOLESTEROL,
}
