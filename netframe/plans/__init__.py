"""How plans are run: sessions, storage of intermediate tables, fixpoint loops, dense numbering."""
