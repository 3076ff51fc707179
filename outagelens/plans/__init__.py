"""Whole jobs: the cleaning plan and the reports on clean tickets."""
