"""Incident-ticket analytics on Spark: cleaning, service KPIs and risk reports."""
