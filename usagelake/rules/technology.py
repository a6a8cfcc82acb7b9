"""Rule data of technology, task-area and manifest detection."""

from __future__ import annotations

from typing import NamedTuple


class Technology(NamedTuple):
    name: str
    aliases: tuple[str, ...]
    contexts: tuple[str, ...]
    extensions: tuple[str, ...]


def _parse(text: str) -> tuple[Technology, ...]:
    rows = []
    for line in text.strip().splitlines():
        name, aliases, contexts, extensions = (part.strip() for part in line.split("|"))
        rows.append(
            Technology(
                name,
                tuple(a.strip() for a in aliases.split(",")),
                tuple(c.strip() for c in contexts.split(",")),
                tuple(e.strip() for e in extensions.split(",") if e.strip()),
            )
        )
    return tuple(rows)


# Technology | whole-word aliases | task areas | file extensions.
TECHNOLOGIES = _parse("""
TypeScript | typescript, ts, tsx, tsc | Backend, Frontend | ts, tsx
JavaScript | javascript, js, esm, node js | Backend, Frontend | js, mjs, cjs
React | react, jsx, usestate, useeffect, react query | Frontend | jsx
Next.js | next js, nextjs, app router | Frontend |
Vue | vue, vuejs, nuxt | Frontend |
Svelte | svelte, sveltekit | Frontend |
Angular | angular, ngmodule | Frontend |
Tailwind CSS | tailwind, tailwindcss | Frontend |
CSS | css, flexbox, grid layout, scss, sass | Frontend | css, scss
HTML | html, markup | Frontend | html
NestJS | nestjs, nest js, nest | Backend |
Express | express, expressjs | Backend |
Fastify | fastify | Backend |
Node.js | node, nodejs, npm, pnpm, yarn | Backend |
Deno | deno | Backend |
Bun | bun | Backend |
Python | python, py, pip, poetry, venv | Backend | py
Django | django | Backend |
FastAPI | fastapi | Backend |
Flask | flask | Backend |
Go | golang, go mod, goroutine | Backend | go
Rust | rust, cargo, tokio, serde | Backend | rs
Java | java, spring boot, maven, gradle | Backend | java
Kotlin | kotlin | Backend | kt
C# | c sharp, csharp, dotnet, asp net | Backend | cs
C++ | c plus plus, cpp | Backend | cpp, hpp
C | ansi c | Backend | c, h
PHP | php, laravel, composer | Backend | php
Ruby | ruby, rails, gemfile | Backend | rb
Swift | swift, swiftui, xcode | Frontend | swift
Flutter | flutter, dart, pubspec | Frontend | dart
Solidity | solidity, smart contract, erc20, erc721 | Smart Contract | sol
Hardhat | hardhat | Smart Contract |
Foundry | foundry, forge test | Smart Contract |
Ethereum | ethereum, evm, web3, ethers, wagmi, viem | Smart Contract |
Blockchain | blockchain, on chain, defi, nft | Smart Contract |
PostgreSQL | postgres, postgresql, psql, pg | Backend |
MySQL | mysql, mariadb | Backend |
SQLite | sqlite, better sqlite | Backend |
MongoDB | mongodb, mongo, mongoose | Backend |
Redis | redis, ioredis | Backend |
Drizzle | drizzle | Backend |
Prisma | prisma | Backend |
GraphQL | graphql, apollo | Backend |
gRPC | grpc, protobuf | Backend |
Docker | docker, dockerfile, container, swarm | Infrastructure |
Kubernetes | kubernetes, k8s, kubectl, helm | Infrastructure |
Terraform | terraform, hcl | Infrastructure |
AWS | aws, s3, lambda, ec2, dynamodb, cloudfront | Infrastructure |
GCP | gcp, google cloud, bigquery, cloud run | Infrastructure |
Azure | azure | Infrastructure |
Nginx | nginx | Infrastructure |
GitHub Actions | github actions, workflow yml | Infrastructure |
Git | git, rebase, merge conflict, commit | Infrastructure |
Linux | linux, ubuntu, debian, bash, systemd | Infrastructure |
Vitest | vitest | Testing |
Jest | jest | Testing |
Playwright | playwright | Testing |
Cypress | cypress | Testing |
Pytest | pytest | Testing |
Vite | vite | Frontend |
Webpack | webpack | Frontend |
ESLint | eslint, linting | Frontend, Backend |
Kafka | kafka | Infrastructure |
RabbitMQ | rabbitmq, amqp | Infrastructure |
Elasticsearch | elasticsearch, opensearch | Infrastructure |
Machine Learning | machine learning, pytorch, tensorflow, scikit, embedding, llm | Research |
SQL | sql, query plan, join, index scan | Backend | sql
Markdown | markdown, mdx | Documentation | md, mdx
YAML | yaml, yml | Infrastructure | yml, yaml
""")

# Confidence of each kind of evidence, and the least share of an area.
ALIAS_CONFIDENCE = 0.85
EXTENSION_CONFIDENCE = 0.7
PROJECT_CONFIDENCE = 0.4
CONTEXT_FLOOR = 0.15


def _context_terms(text: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    rows = []
    for line in text.strip().splitlines():
        context, terms = line.split("|")
        rows.append((context.strip(), tuple(t.strip() for t in terms.split(","))))
    return tuple(rows)


# Task area | whole-word terms, in scoring order.
CONTEXT_TERMS = _context_terms("""
Backend | api, endpoint, server, database, migration, query, service layer, controller
Frontend | ui, component, page, styling, layout, responsive, accessibility, browser
Smart Contract | on chain, onchain, erc20, erc721, gas limit, gas optimization, smart contract, token contract
Infrastructure | deploy, pipeline, infrastructure, server config, scaling, monitoring
Testing | test, coverage, assertion, mock, fixture
Architecture | architecture, design, structure, pattern, boundary, trade off
Documentation | docs, documentation, readme, guide, changelog
Research | research, compare, evaluate, investigate, benchmark, options
""")

# Package manifests read, and what their content reveals.
MANIFEST_FILES = (
    "package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml",
    "build.gradle", "Gemfile", "composer.json", "hardhat.config.ts", "hardhat.config.js",
    "foundry.toml",
)
MANIFEST_SIGNALS = (
    ("Next.js", r'"next"\s*:'),
    ("React", r'"react"\s*:'),
    ("Vue", r'"vue"\s*:'),
    ("Svelte", r'"svelte"\s*:'),
    ("Angular", r'"@angular/core"\s*:'),
    ("NestJS", r'"@nestjs/core"\s*:'),
    ("Express", r'"express"\s*:'),
    ("Fastify", r'"fastify"\s*:'),
    ("Tailwind CSS", r'"tailwindcss"\s*:'),
    ("Drizzle", r'"drizzle-orm"\s*:'),
    ("Prisma", r'"prisma"\s*:'),
    ("Vitest", r'"vitest"\s*:'),
    ("Jest", r'"jest"\s*:'),
    ("Playwright", r'"@playwright/test"\s*:'),
    ("TypeScript", r'"typescript"\s*:'),
    ("Django", r"(?im)^django"),
    ("FastAPI", r"(?im)^fastapi"),
    ("Flask", r"(?im)^flask"),
    ("Pytest", r"(?im)^pytest"),
    ("Rust", r"\[dependencies\]"),
    ("Go", r"(?m)^module\s+\S+"),
    ("Hardhat", r"(?i)hardhat"),
    ("Foundry", r"(?i)foundry"),
)
