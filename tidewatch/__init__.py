"""Incident analytics over metric, log, alert and dashboard tables, built on Spark DataFrames."""
