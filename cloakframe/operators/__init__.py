"""Operators on whole tables: groups, rules, partitioning, lattices, clustering and migration."""
