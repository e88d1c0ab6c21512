"""Model families: forest, tree, logistic, kNN, AdaBoost, kernel SVM."""
