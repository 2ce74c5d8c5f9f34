"""Front ends: each reads one file's text and adds what it finds to `Facts`."""
