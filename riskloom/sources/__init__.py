"""Reading requests, events and indexes; writing answers."""
