"""Edit events and arriving pictures as streams."""
