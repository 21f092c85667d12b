"""Relational and iterative operators: nearest clusters, clustering, ordered work, evaluation, restructuring."""
