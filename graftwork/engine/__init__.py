"""What needs a tree as a whole: similarity, diff, patterns, symbols, calls, data flow, guards, merge. No Spark here."""
