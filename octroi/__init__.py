"""Spark batch engine for closed-toll networks: fare cleaning, audits, graph tables and routes."""
