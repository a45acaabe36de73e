"""Readers and writers of document files, and views of the test tables as documents."""
