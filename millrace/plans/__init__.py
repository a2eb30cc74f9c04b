"""Physical building blocks that keep working when one group holds much of the data."""
