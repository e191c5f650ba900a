"""Named queries over the supplied tables, each with its SQL oracle where SQL can say it."""
