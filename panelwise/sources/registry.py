"""Which file feeds which table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    file: str
    table: str
    description: str


# Survey components of the 2021-2023 cycle.
SURVEY = (
    Entry("DEMO_L.xpt", "demographics", "Demographics & Sample Weights"),
    Entry("DR1TOT_L.xpt", "dietary_total_day1", "Dietary Recall - Total Nutrients, Day 1"),
    Entry("DR2TOT_L.xpt", "dietary_total_day2", "Dietary Recall - Total Nutrients, Day 2"),
    Entry("BMX_L.xpt", "body_measures", "Body Measures (BMI, Weight, Height)"),
    Entry("BPXO_L.xpt", "blood_pressure", "Blood Pressure"),
    Entry("GLU_L.xpt", "glucose", "Fasting Glucose"),
    Entry("GHB_L.xpt", "hba1c", "Glycohemoglobin (HbA1c)"),
    Entry("INS_L.xpt", "insulin", "Fasting Insulin"),
    Entry("CBC_L.xpt", "cbc", "Complete Blood Count"),
    Entry("FERTIN_L.xpt", "ferritin", "Ferritin"),
    Entry("TFR_L.xpt", "transferrin", "Transferrin Receptor"),
    Entry("VID_L.xpt", "vitamin_d", "Vitamin D (25-OH)"),
    Entry("FOLFMS_L.xpt", "folate_b12", "Folate & B12"),
    Entry("TCHOL_L.xpt", "cholesterol_total", "Total Cholesterol"),
    Entry("HDL_L.xpt", "cholesterol_hdl", "HDL Cholesterol"),
    Entry("TRIGLY_L.xpt", "cholesterol_trigly", "Triglycerides & LDL"),
    Entry("DIQ_L.xpt", "diabetes", "Diabetes Questionnaire"),
    Entry("BPQ_L.xpt", "bp_cholesterol_q", "Blood Pressure & Cholesterol Questionnaire"),
    Entry("MCQ_L.xpt", "medical_conditions", "Medical Conditions"),
    Entry("PAQ_L.xpt", "physical_activity", "Physical Activity"),
    Entry("HIQ_L.xpt", "insurance", "Health Insurance"),
    Entry("HUQ_L.xpt", "healthcare_util", "Healthcare Utilization"),
    Entry("RXQ_RX_L.xpt", "medications", "Prescription Medications"),
    Entry("WHQ_L.xpt", "weight_history", "Weight History"),
    Entry("FSQ_L.xpt", "food_security", "Food Security"),
    Entry("SLQ_L.xpt", "sleep", "Sleep Disorders"),
    Entry("KIQ_U_L.xpt", "kidney", "Kidney Conditions"),
)


def registry(spark: SparkSession, entries: Sequence[Entry] = SURVEY) -> DataFrame:
    """The entries as a table, to join with load results."""
    return spark.createDataFrame(
        [tuple(e) for e in entries], "file string, table string, description string"
    )
