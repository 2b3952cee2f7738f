"""booktext: Spark jobs that turn libraries of e-books and web pages into text books."""
