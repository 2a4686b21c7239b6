"""Named studies over the survey tables, and the cohort they share."""
