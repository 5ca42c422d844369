"""Prose analytics on Spark: text rules, findings, verdicts and blinded-study arithmetic as DataFrame plans."""
