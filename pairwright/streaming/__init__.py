"""The batch aggregations over inputs that keep growing."""
