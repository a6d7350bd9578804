def never(): pass
