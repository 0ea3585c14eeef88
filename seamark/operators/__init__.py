"""Relational operators: ranks, first rows, statistics, samples, profiles, metrics, graphs."""
