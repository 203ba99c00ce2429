"""Tie-break columns that make every window order total (quirk Q3).

The reference orders by one column only, so ties fall arbitrarily and two
windows over the same rows may disagree. Every operator here takes its
tie-break as an argument; these are the defaults for the listings schema."""

# Default total orders (FIXTURES.md section 2).
TIME_TIEBREAK = ("seq1", "seq2", "price")          # after updated_at, within one id
CHEAP_TIEBREAK = ("id", "updated_at", "seq1", "seq2")  # after price, within one location
MOVER_TIEBREAK = ("id", "updated_at", "seq1", "seq2", "price")  # after abs_pct_change
