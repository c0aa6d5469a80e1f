"""What the test tables need in place of a real model and lexicon."""
