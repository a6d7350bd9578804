x = 1 
